"""Rows that must not get lost: NULL keys, folder tables, unlisted items, users with alerts only."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F


def bars_with_nulls(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day + dt.timedelta(i), float(i)) for i in range(5)] + [(None, day, 7.0), ("A", None, 8.0), (None, None, 9.0)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_series_index_and_chunks_keep_null_keys(spark):
    from tickweave.functions.indicators import add_indicators
    from tickweave.operators.series import series_index
    b = bars_with_nulls(spark)
    ix = series_index(b)
    assert ix.count() == 8 and ix.columns == [*b.columns, "series_len", "series_idx"]
    whole = add_indicators(b, price_scale=2)
    pieces = add_indicators(b, price_scale=2, chunk_rows=300)
    key = lambda rows: sorted(map(str, rows))
    assert key(pieces.select(*whole.columns).collect()) == key(whole.collect())


def test_rotating_pick_keeps_the_null_group(spark):
    from tickweave.operators.feeds import rotating_pick
    items = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "src string, feed_pos long")
    for width in (None, 2):
        got = {r.src: r.feed_pos for r in rotating_pick(items, 1, "src", bucket_width=width).collect()}
        assert got == {"a": 2, None: 4}


def test_article_card_takes_empty_texts_as_missing(spark):
    from tickweave import constants as K
    from tickweave.operators.feeds import article_card
    news = spark.createDataFrame([("", "", "", dt.datetime(2024, 1, 1))], "description string, content string, url string, published_at timestamp")
    r = article_card(news).first()
    assert (r.description_text, r.content_text, r.link) == (K.NO_DESCRIPTION, K.NO_CONTENT, None)


def test_statement_keeps_unlisted_items_and_text_columns(spark):
    from tickweave.operators.statements import fill_and_stringify, statement_wide
    long = spark.createDataFrame([("S", 1, "Revenue", 2.0), ("S", 1, "EBITDA", 3.0), ("T", 1, "Revenue", 1.0)],
                                 "symbol string, period int, item string, value double")
    got = {r.symbol: r for r in statement_wide(long, ["Revenue"], other="other_items").collect()}
    assert got["S"].other_items == {"EBITDA": 3.0} and got["T"].other_items is None and got["T"].Revenue == 1.0
    mixed = spark.createDataFrame([("S", 1, "text", None)], "symbol string, period int, note string, v double")
    assert tuple(fill_and_stringify(mixed).first()) == ("S", 1, "text", "N/A")


def test_settings_of_users_with_alerts_only(spark):
    from tickweave.sources.sinks import settings_json
    favs = spark.createDataFrame([(1, ["A"])], "user_id long, favorites array<string>")
    alerts = spark.createDataFrame([(2, "B", 3.0)], "user_id long, symbol string, price double")
    got = {r.user_id: json.loads(r.settings_json) for r in settings_json(favs, alerts).collect()}
    assert got[1]["favorites"] == ["A"] and got[1]["alerts"] == []
    assert got[2]["favorites"] == [] and got[2]["alerts"] == [{"stock": "B", "price": 3.0}]


def test_settings_of_users_with_holdings_or_seen_urls_only(spark):
    from tickweave.sources.sinks import settings_json
    favs = spark.createDataFrame([(1, ["A"])], "user_id long, favorites array<string>")
    held = spark.createDataFrame([(2, "b", 2.0, 3.5), (2, "A", 1.0, 9.0), (None, "C", 1.0, 1.0)],
                                 "user_id long, symbol string, quantity double, buy_price double")
    seen = spark.createDataFrame([(3, "u2"), (3, "u1"), (3, "u2"), (1, "u9")], "user_id long, url string")
    got = {r.user_id: json.loads(r.settings_json) for r in settings_json(favs, holdings=held, seen=seen).collect()}
    assert set(got) == {1, 2, 3, None} and got[1]["favorites"] == ["A"] and got[1]["seen_articles"] == ["u9"]
    assert got[2]["portfolio"] == [{"ticker": "A", "quantity": 1.0, "buy_price": 9.0}, {"ticker": "B", "quantity": 2.0, "buy_price": 3.5}]
    assert got[3] == {"favorites": [], "portfolio": [], "seen_articles": ["u1", "u2"], "model_config": {"epochs": 20, "batch_size": 32}}


def test_stream_reads_a_table_stored_as_a_folder(spark, scratch):
    from tickweave.streaming import streams as T
    table = os.path.join(scratch, "events.parquet")
    spark.range(10).repartition(3).write.parquet(table)
    _, out = T.run_to_files(T.table_stream(spark, scratch, "events", max_files=1), "folder",
                            checkpoint=os.path.join(scratch, "ck"), out=os.path.join(scratch, "out"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_unreadable_history_fails_the_batch(spark, scratch):
    from tickweave.streaming import streams as T
    out = os.path.join(scratch, "out")
    seen = spark.createDataFrame([], "url string")
    write = T.unseen_batch_writer(seen, out)
    write(spark.createDataFrame([("u", 1)], "url string, feed_pos long"), 0)
    part = next(f for f in os.listdir(f"{out}/batch_id=0") if f.endswith(".parquet"))
    with open(f"{out}/batch_id=0/{part}", "wb") as f:
        f.write(b"damaged")
    with pytest.raises(Exception):
        write(spark.createDataFrame([("u", 1), ("v", 2)], "url string, feed_pos long"), 1)


def test_exact_news_across_batches(spark, scratch):
    from tickweave.streaming import streams as T
    out = os.path.join(scratch, "out")
    write = T.unseen_batch_writer(spark.createDataFrame([("s",)], "url string"), out)
    for i, urls in enumerate([["a", "s"], ["a", "b"], ["b", "c"]]):
        write(spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, feed_pos long"), i)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_late_bars_are_never_dropped(spark, scratch):
    from tickweave.sources.bars import BAR_COLUMNS
    from tickweave.streaming import streams as T
    tail, out = os.path.join(scratch, "tail"), os.path.join(scratch, "out")
    write = T.indicator_batch_writer(tail, out, price_scale=2)
    day = dt.date(2020, 1, 1)
    one = {c: F.lit(1.0) for c in BAR_COLUMNS if c not in ("symbol", "date", "volume")} | {"volume": F.lit(1).cast("long")}
    frame = lambda days: spark.createDataFrame([("A", d) for d in days], "symbol string, date date").withColumns(one)
    write(frame([day + dt.timedelta(i) for i in range(1, 400)]), 0)
    write(frame([day]), 1)
    kept = T.current_indicators(spark, out).count()
    assert kept + spark.read.parquet(out + "_rejected").count() == 400


def test_submitted_shuffle_partitions_survive():
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession\n"
            "SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
            ".config('spark.sql.shuffle.partitions', '37').getOrCreate()\n"
            "import pyspark.sql.session as s\n"
            "s.SparkSession.builder._options.clear()\n"
            "from tickweave.session import get_session\n"
            "print('partitions', get_session().conf.get('spark.sql.shuffle.partitions'))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert "partitions 37" in got.stdout, got.stderr[-2000:]
