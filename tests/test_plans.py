"""Physical-plan shape: the properties the scale design relies on."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.functions.indicators import add_indicators
from tickweave.operators.series import tail
from tickweave.sources.bars import daily_bars, load_bars


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_use_hash_aggregate_with_partial_phase(spark):
    p = _plan(daily_bars(spark, SF_SMALL))
    assert "SortAggregate" not in p
    assert "partial_min_by" in p and "partial_max_by" in p


def test_indicators_share_one_exchange_and_sort(spark):
    df = add_indicators(daily_bars(spark, SF_SMALL), price_scale=2)
    p = _plan(df)
    # one Exchange for the bars aggregate, one for the symbol window
    assert p.count("Exchange hashpartitioning") == 2
    assert p.count("Window [") == 2


def test_load_bars_filter_reaches_the_scan(spark, scratch):
    daily_bars(spark, SF_SMALL).write.parquet(f"{scratch}/bars")
    df = load_bars(spark.read.parquet(f"{scratch}/bars"), "1997-01-01", "2000-01-01").select("symbol", "close")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,1997-01-01), LessThan(date,2000-01-01)]" in p
    assert "ReadSchema: struct<symbol:string,date:date,close:double>" in p


def test_tail_uses_window_group_limit(spark):
    p = _plan(tail(daily_bars(spark, SF_SMALL), 50))
    assert "WindowGroupLimit" in p


def test_no_python_udf_in_catalog_plans(spark):
    import __spark_entry__ as E
    for name in ["e2_indicators", "e3_signal", "j1_value_holdings", "l2_rotating_pick", "r1_statement_wide"]:
        p = _plan(E.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_chunked_samples_equal_whole_series(spark):
    from tickweave.plans.forecast import samples
    from tickweave.sources.bars import smooth_bars
    b = smooth_bars(daily_bars(spark, SF_SMALL))
    cols = ["symbol", "date", "label", "prev", "features", "sample_idx", "is_train"]
    a = samples(b, 30).select(*cols).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    c = samples(b, 30, chunk_rows=64).select(*cols)
    assert a.count() == c.count() and a.exceptAll(c).count() == 0


def test_pooled_and_ar1_paths_share_their_samples(spark):
    """The pooled model reads the same samples (and split) as the twin-checked AR(1) path."""
    from tickweave.plans.forecast import samples
    from tickweave.sources.bars import smooth_bars
    b = smooth_bars(daily_bars(spark, SF_SMALL))
    cols = ["symbol", "date", "label", "prev", "is_train"]
    full = samples(b, 30).select(*cols)
    lean = samples(b, 30, with_features=False).select(*cols)
    assert full.count() == lean.count() and full.exceptAll(lean).count() == 0


def test_hot_symbol_is_split_into_bounded_groups(spark):
    """One symbol with most of the rows: its halo chunks stay at most rows_per_chunk + halo
    rows, and the chunked indicators still equal the whole-series ones."""
    import datetime as dt
    from tickweave.operators.series import series_chunks
    d0 = dt.date(2000, 1, 1)
    rows = [("HOT", d0 + dt.timedelta(days=i), 100.0 + (i % 37) * 0.5) for i in range(3600)]
    rows += [(f"S{k}", d0 + dt.timedelta(days=i), 50.0 + (i % 11)) for k in range(10) for i in range(300)]
    df = spark.createDataFrame([(s, d, c, c, c, c, 1.0) for s, d, c in rows],
                               "symbol string, date date, open double, high double, low double, close double, volume double")
    ch = series_chunks(df, halo=200, rows_per_chunk=500)
    biggest = ch.groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 700
    assert ch.filter(~F.col("_halo")).count() == df.count()
    whole = add_indicators(df, price_scale=2)
    parts = add_indicators(df, price_scale=2, chunk_rows=500)
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_rotating_pick_numbers_only_one_bucket_of_a_hot_source(spark):
    from tickweave.operators.feeds import rotating_pick
    rows = [("hot", i, f"h{i}") for i in range(5000)] + [("cold", i, f"c{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "src string, feed_pos long, title string")
    got = {r.src: r.title for r in rotating_pick(df, 4321, "src", bucket_width=256).collect()}
    assert got == {"hot": "h4321", "cold": "c1"}  # 4321 mod 5000 = 4321, 4321 mod 3 = 1


def test_bucketed_bar_table_needs_no_exchange(spark):
    from tickweave.sources.bars import read_bars, store_bars
    name = store_bars(daily_bars(spark, SF_SMALL), buckets=4)
    df = add_indicators(read_bars(spark, name), price_scale=2)
    p = _plan(df)
    assert "Exchange" not in p and p.count("Window [") == 2
    assert df.exceptAll(add_indicators(daily_bars(spark, SF_SMALL), price_scale=2)).count() == 0


def test_series_index_exchanges_its_rows_once(spark):
    """The numbering and the join on the counts share one partitioning; chunked samples scale last."""
    from tickweave.operators.series import series_index
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("string").alias("symbol"),
                                     F.expr("IF(id = 0, NULL, date_add(DATE'2024-01-01', int(id)))").alias("date"))
        ix = series_index(df)
        # rows and their counts by (symbol, month), counts by symbol, offsets by (symbol, month)
        assert ix._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        assert sorted(r.series_idx for r in ix.filter("symbol IS NULL").collect()) == list(range(34))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
