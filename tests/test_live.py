"""Live state: versioned tables, indicators with bars of any age (T5), alerts both ways (T6), the seen index (T2)."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.functions.indicators import add_indicators
from tickweave.sources.bars import daily_bars
from tickweave.streaming.live import LiveAlerts, LiveIndicators
from tickweave.streaming.seen import IndexedNews, SeenIndex
from tickweave.streaming.versions import VersionedTable


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Small tables: many short jobs, not large ones."""
    small = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k, "true") for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(a, b):
    a = a.select(*b.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --- versioned tables -----------------------------------------------------------------------------

def test_readers_get_whole_versions_while_newer_ones_are_written(spark, scratch):
    t = VersionedTable(spark, scratch, keep=2)
    assert t.read() is None and t.version() is None
    frame = lambda k, n: spark.range(n).select(F.lit(k).alias("k"))
    t.write(frame(0, 5), 0)
    held = t.read()
    t.write(frame(1, 7), 1)
    assert {r.k for r in held.collect()} == {0} and held.count() == 5  # taken before, still whole
    t.write(frame(2, 3), 2)
    assert t.read().count() == 3 and t.version() == 2 and t.version(below=2) == 1
    assert sorted(os.listdir(f"{scratch}/data")) == sorted(n for n in os.listdir(f"{scratch}/commits") if not n.endswith(".crc"))
    assert len(os.listdir(f"{scratch}/data")) == 2
    with pytest.raises(ValueError):
        t.write(frame(0, 1), 1)


def test_a_failed_or_repeated_version_is_replaced(spark, scratch):
    t = VersionedTable(spark, scratch)
    t.write(spark.range(4), 0)
    os.makedirs(f"{scratch}/data/{1:019d}.000001")  # a writer that died before it committed
    assert t.read().count() == 4 and t.version() == 0
    t.write(spark.range(9), 1)
    t.write(spark.range(6), 1)  # the batch runs again
    assert t.read().count() == 6 and t.read(below=1).count() == 4
    c = VersionedTable(spark, f"{scratch}/csv", fmt="csv")
    c.write(spark.range(3).select("id", F.lit("x").alias("s")), 0, partition_by=["s"], header=True)
    assert c.read(header=True).count() == 3


# --- T5 -------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bars(spark):
    return daily_bars(spark, SF_SMALL).cache()


def test_bars_in_random_order_give_the_batch_result(spark, scratch, bars):
    live = LiveIndicators(spark, scratch, price_scale=2, compact_every=3, month_files=1)
    parts = bars.withColumn("part", F.pmod(F.xxhash64("symbol", "date"), F.lit(4)))
    for k in range(4):
        live.write(parts.filter(F.col("part") == k), k)
    assert same(live.current(), add_indicators(bars, price_scale=2))
    assert not os.path.exists(f"{scratch}_rejected")
    assert len(os.listdir(f"{scratch}/rows")) <= 4  # compacted after the third batch


def test_late_replayed_and_corrected_bars(spark, scratch, bars):
    live = LiveIndicators(spark, scratch, price_scale=2, month_files=2)
    symbol = bars.select("symbol").first()[0]
    dates = [r[0] for r in bars.filter(F.col("symbol") == symbol).orderBy("date").select("date").collect()]
    late = (F.col("symbol") == symbol) & F.col("date").isin(dates[3], dates[-2], dates[250])
    live.write(bars.filter(~late), 0)
    live.write(bars.filter(late), 1)
    live.write(bars.filter(late), 1)  # again, after a failure
    assert same(live.current(), add_indicators(bars, price_scale=2))
    fixed = bars.withColumn("close", F.when((F.col("symbol") == symbol) & (F.col("date") == dates[100]), F.lit(1234.5)).otherwise(F.col("close")))
    live.write(fixed.filter((F.col("symbol") == symbol) & (F.col("date") == dates[100])), 2)
    assert same(live.current(), add_indicators(fixed, price_scale=2))
    live.write(bars.filter("false"), 3)
    live.write(bars.filter("symbol IS NULL").unionByName(bars.limit(1).withColumn("date", F.lit(None).cast("date"))), 4)
    assert live.state.version() == 2


def test_a_late_bar_reads_and_writes_only_cells_near_it(spark, scratch, bars):
    live = LiveIndicators(spark, scratch, price_scale=2, month_files=2)
    live.write(bars, 0)
    state = live.state.read()
    touched = spark.createDataFrame([(bars.select("symbol").first()[0], "1995-03")], "symbol string, month string")
    cells = live.plan(state, touched).orderBy("month").collect()
    per_month = bars.count() / state.count()
    near = int(live.lookback / per_month) + 3
    assert {c.symbol for c in cells} == {touched.first().symbol} and len(cells) <= 2 * near
    written = [c.month for c in cells if c.emit]
    assert min(written) == "1995-03" and len(written) <= near and len(cells) < state.filter(F.col("symbol") == touched.first().symbol).count()


def test_a_batch_exchanges_its_cells_once_and_reads_move_none(spark, scratch, bars):
    """Bars meet what is there where the indicators are computed; rows of the newest folder, and of folders with a few
    cells left, are read as they lie."""
    live = LiveIndicators(spark, scratch, price_scale=2, month_files=1)
    live.write(bars.filter(F.month("date") < 7), 0)
    live.write(bars.filter(F.month("date") >= 7), 1)
    plan = live.current()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert same(live.current(), add_indicators(bars, price_scale=2))


def test_replay_stores_no_row_twice_and_an_empty_slice_is_a_batch(spark, scratch, monkeypatch):
    from tickweave.streaming import streams as T
    monkeypatch.setattr(T, "shared_dir", lambda spark, name: f"{scratch}/{name}")
    rows = spark.range(100).withColumn("part", F.when(F.col("id") < 40, 0).otherwise(2))
    got = []
    T.replay(rows.repartition(3), F.col("part"), 3, "r", lambda batch, k: got.append((k, sorted(r.id for r in batch.collect()))))
    assert got == [(0, list(range(40))), (1, []), (2, list(range(40, 100)))]
    files = [f"{at}/{f}" for at, _, fs in os.walk(scratch) for f in fs if f.endswith(".parquet")]
    assert sum(spark.read.parquet(f).count() for f in files) == 100
    T.replay(rows.limit(0), F.col("part"), 2, "none", lambda batch, k: got.append((k, batch.count())))
    assert got[3:] == [(0, 0), (1, 0)]


# --- T6 -------------------------------------------------------------------------------------------

TICK = "symbol string, ts timestamp, seq long, price double"


def brute_alerts(ticks, alerts):
    last, fired = {}, {}
    for symbol, ts, seq, price in sorted(ticks, key=lambda t: (t[1], t[2])):
        prev = last.get(symbol)
        last[symbol] = price
        for alert, s, level in alerts:
            if s == symbol and prev is not None and alert not in fired and (prev < level <= price or prev > level >= price):
                fired[alert] = ("up" if prev < price else "down", ts, seq, prev, price)
    return fired


def test_alerts_cross_both_ways_within_and_between_batches(spark, scratch):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    ticks, price = [], {s: 100.0 for s in "ABC"}
    for k in range(600):
        s = rng.choice("AAAABC")
        price[s] = round(max(1.0, price[s] + rng.uniform(-9, 9)), 2)
        ticks.append((s, start + dt.timedelta(minutes=17 * k), k, price[s]))
    alerts = [(k, rng.choice("ABCD"), round(rng.uniform(-20, 400), 2)) for k in range(120)] + [(500, "A", ticks[3][3])]
    live = LiveAlerts(spark, spark.createDataFrame(alerts, "alert_id long, symbol string, price double"), scratch)
    seen = 0
    for k, at in enumerate(range(0, 600, 150)):
        batch = spark.createDataFrame(ticks[at:at + 150], TICK)
        live.write(batch, k)
        if k == 2:
            live.write(batch, k)  # again
        now = live.fired_so_far().count()
        assert now >= seen
        seen = now
    got = {r.alert_id: (r.direction, r.ts, r.seq, r.prev_price, r.price) for r in live.fired_so_far().collect()}
    assert got == brute_alerts(ticks, alerts) and 0 < len(got) < len(alerts)
    assert {v[0] for v in got.values()} == {"up", "down"}


def test_alerts_of_odd_ticks(spark, scratch):
    live = LiveAlerts(spark, spark.createDataFrame([(1, "A", 10.0), (2, "A", 5.0)], "alert_id long, symbol string, price double"), scratch)
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    live.write(spark.createDataFrame([("A", t(5), 1, 9.0), ("A", None, 2, 99.0), ("A", t(6), 3, None), (None, t(6), 4, 7.0)], TICK), 0)
    assert live.fired_so_far().count() == 0  # a first tick crosses nothing
    live.write(spark.createDataFrame([("A", t(1), 0, 50.0)], TICK), 1)  # older than what is known
    assert live.fired_so_far().count() == 0
    live.write(spark.createDataFrame([], TICK), 2)
    live.write(spark.createDataFrame([("A", t(7), 5, 10.0)], TICK), 3)
    assert [(r.alert_id, r.direction, r.prev_price, r.batch_id) for r in live.fired_so_far().collect()] == [(1, "up", 9.0, 3)]


def test_an_alert_meets_the_tick_that_first_reaches_it(spark, scratch, monkeypatch):
    from tickweave.streaming import live as module
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    ticks = [(s, start + dt.timedelta(minutes=7 * k), 10 * k + j, float(rng.randint(0, 60))) for k in range(400) for j, s in enumerate("AB")]
    alerts = [(k, "AB"[k % 2], k / 4 - 5) for k in range(300)]  # every price, the start prices too
    found = []
    crossings = module.crossings
    monkeypatch.setattr(module, "crossings", lambda moves, waiting: (lambda met: (found.append(met.count()), met)[1])(crossings(moves, waiting)))
    live = LiveAlerts(spark, spark.createDataFrame(alerts, "alert_id long, symbol string, price double"), scratch)
    for k, at in enumerate((0, 6, 300, 800)):
        live.write(spark.createDataFrame(ticks[at:(6, 300, 800, 800)[k]], TICK), k)
    got = {r.alert_id: (r.direction, r.ts, r.seq, r.prev_price, r.price) for r in live.fired_so_far().collect()}
    assert got == brute_alerts(ticks, alerts) and {a for a, s, p in alerts if p in (ticks[0][3], ticks[1][3])} & set(got)
    assert len(got) <= sum(found) <= 3 * len(alerts)  # not every tick that crosses an alert


# --- T2 -------------------------------------------------------------------------------------------

def test_index_reads_stay_flat_while_the_history_grows(spark, scratch):
    index = SeenIndex(spark, scratch, part_urls=16, first_parts=2)
    rng, known, total, reads = random.Random(5), set(), 0, []
    for batch in range(50):
        urls = {f"u{total + k}" for k in range(6)} | set(rng.sample(sorted(known), min(1, len(known)))) | ({None} if batch == 7 else set())
        total += 6
        frame = spark.createDataFrame([(u,) for u in urls], "url string").coalesce(2)
        got = {r.url for r in index.add(frame, batch).collect()}
        assert got == urls - known
        reads.append(index.last_read)
        if batch == 20:  # runs again
            assert {r.url for r in index.add(frame, batch).collect()} == urls - known
        known |= urls - {None}
    late = [r["urls_read"] for r in reads[35:]]
    assert max(late) <= 3 * 16 < total / 4  # an old url a batch reads its part, not the history
    assert reads[49]["parts"] > reads[0]["parts"] and all(r["parts_read"] <= 2 for r in reads)


def test_filters_hold_every_word_without_look_ups(spark, scratch):
    index = SeenIndex(spark, scratch, part_urls=64, first_parts=2)
    urls = spark.createDataFrame([(f"u{k}",) for k in range(40)], "url string").select("url", index._hash().alias("h")).withColumn("part", F.pmod("h", F.lit(2)).cast("int"))
    filters = index._filters(urls, spark.createDataFrame([(0, [1] * (index.bits // 64)), (5, [2] * (index.bits // 64))], "part int, words array<long>"))
    assert "map_from_entries" not in filters._jdf.queryExecution().optimizedPlan().toString()  # m[w] searches a map from its start
    got = {r.part: r.words for r in filters.collect()}
    assert set(got) == {0, 1, 5} and {len(w) for w in got.values()} == {index.bits // 64} and got[5] == [2] * (index.bits // 64)
    assert all(w & 1 for w in got[0]) and urls.join(filters, "part").filter(index._perhaps()).count() == 40


def test_indexed_news_first_in_feed_order_and_replay(spark, scratch):
    schema = "url string, feed_pos long, title string"
    live = IndexedNews(spark, spark.createDataFrame([("s",)], "url string"), scratch, part_urls=8, first_parts=1)
    live.write(spark.createDataFrame([("a", 3, "a-late"), ("a", 1, "a-first"), (None, 2, "n1"), ("s", 4, "seen")], schema), 0)
    second = spark.createDataFrame([("a", 5, "again"), (None, 6, "n2"), ("b", 7, "b")], schema)
    live.write(second, 1)
    live.write(second, 1)
    live.write(spark.createDataFrame([], schema), 2)
    got = sorted((r.url or "", r.title, r.batch_id) for r in live.news().collect())
    assert got == [("", "n1", 0), ("a", "a-first", 0), ("b", "b", 1)]


# --- A1, L2 ---------------------------------------------------------------------------------------

def test_portfolio_totals_follow_quotes(spark, scratch):
    from tickweave.operators.portfolio import clean_holdings, holding_pnl, portfolio_totals
    from tickweave.streaming.portfolio import LivePortfolios
    rng = random.Random(8)
    holdings = spark.createDataFrame(
        [(rng.randrange(12), rng.choice(["a", "B", "c", "D", "E", "f", "", None]), float(rng.randint(0, 9)), float(rng.randint(0, 50))) for _ in range(200)],
        "portfolio_id long, symbol string, quantity double, buy_price double")
    live = LivePortfolios(spark, scratch, parts=5, fold_every=2)
    live.load(holdings)
    assert live.totals().count() == 0
    last, seq = {}, 0
    for k in range(6):
        ticks = []
        for _ in range(rng.randint(0, 6) if k != 3 else 0):
            seq += 1
            ticks.append((rng.choice("ABCDEZ"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq), seq, float(rng.randint(1, 99))))
        for s, _, _, p in ticks:
            last[s] = p
        ticks += [("A", dt.datetime(2023, 1, 1), 0, 5.0), ("A", None, 1, 5.0), (None, dt.datetime(2025, 1, 1), 1, 5.0)] if "A" in last else []
        batch = spark.createDataFrame(ticks, TICK)
        live.write(batch, k)
        if k in (2, 4):
            live.write(batch, k)  # again
        prices = spark.createDataFrame(list(last.items()), "symbol string, current_price double")
        want = portfolio_totals(holding_pnl(clean_holdings(holdings).join(prices, "symbol")))
        tidy = lambda d: {r[0]: (r[1], *[round(v, 6) for v in r[2:]]) for r in d.collect()}
        assert tidy(live.totals()) == tidy(want)
    assert len(os.listdir(f"{scratch}/deltas")) < 8


def test_quotes_read_only_parts_with_changed_symbols(spark, scratch):
    from tickweave.streaming.portfolio import LivePortfolios
    live = LivePortfolios(spark, scratch, parts=16)
    live.load(spark.createDataFrame([(k, f"S{k}", 1.0, 1.0) for k in range(100)], "portfolio_id long, symbol string, quantity double, buy_price double"))
    read = []
    there = live._there
    live._there = lambda parts: (read.append(len(parts)), there(parts))[1]
    tick = lambda p: spark.createDataFrame([("S5", dt.datetime(2024, 1, 1), p, float(p))], TICK)
    live.write(tick(1), 0)
    live.write(tick(2), 1)
    assert read == [1, 1] and [r.total_value for r in live.totals().collect()] == [2.0]


def test_rotation_over_a_growing_feed_equals_the_batch_pick(spark, scratch):
    from tickweave.operators.feeds import rotating_pick
    from tickweave.streaming.portfolio import LiveRotation
    rng = random.Random(2)
    schema = "src string, feed_pos long, title string"
    live, rows, pos = LiveRotation(spark, scratch, "src", width=8), [], 0
    for batch in range(4):
        new = []
        for _ in range(rng.randint(5, 30)):
            pos += rng.randint(1, 3)
            new.append((rng.choice(["a", "a", "a", "b", None]), pos, f"t{pos}"))
        rng.shuffle(new)
        frame = spark.createDataFrame(new + [("a", None, "nowhere")], schema)
        live.write(frame, batch)
        live.write(frame, batch)
        rows += new
        for k in (7, 1001) if batch % 2 else ():
            want = rotating_pick(spark.createDataFrame(rows, schema), k, "src")
            assert same(live.pick(k, frame.schema), want)
