"""Streaming twins: availableNow runs over a table split into several files
equal the batch result; a restart from the checkpoint with a re-sent file adds nothing; a
replayed foreachBatch id does not duplicate; watermark handling of late ticks."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.sources.bars import build_bars
from tickweave.sources.fixtures import news_from, quotes, quotes_from, seen
from tickweave.operators.feeds import unseen
from tickweave.sources.fixtures import news
from tickweave.streaming import streams as T


_STAMPED: set = set()


def _stamp_new(folder, i):
    """The file source takes files oldest first and writes within one second tie, so each
    newly written file gets its own modification time, in write order."""
    base = time.time() - 3600
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        if f.endswith(".parquet") and path not in _STAMPED:
            _STAMPED.add(path)
            os.utime(path, (base + i * 10, base + i * 10))


def _split_events(spark, scratch, parts=3):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = os.path.join(scratch, "events")
    # time-ordered slices, one file each, written in time order
    ev = ev.withColumn("_slice", F.ntile(parts).over(__import__("pyspark.sql").sql.Window.orderBy("ts")))
    for i in range(1, parts + 1):
        ev.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(src)
        _stamp_new(src, i)
    return src, ev.drop("_slice").schema


def test_stream_bars_equal_batch_and_survive_restart(spark, scratch):
    src, schema = _split_events(spark, scratch)
    ck, out = os.path.join(scratch, "ck"), os.path.join(scratch, "out")
    stream = T.parquet_stream(spark, src, schema=schema, max_files=1)
    live = T.stream_bars(quotes_from(stream), "1 hour", "2 hours", seq="event_id")
    T.run_to_files(live, "bars", checkpoint=ck, out=out)
    got = spark.read.parquet(out)
    n1 = got.count()
    # batch twin: every closed hour (end <= max ts - 2 h) of the batch bars
    q = quotes(spark, SF_SMALL)
    max_ts = q.agg(F.max("ts")).first()[0]
    batch = build_bars(q.withColumn("qty", F.lit(1.0)), seq=["event_id"], every="1 hour") \
        .filter(F.col("bar_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(max_ts) - F.expr("INTERVAL 2 HOURS"))
    a = got.select("symbol", "bar_start", "open", "high", "low", "close")
    b = batch.select("symbol", "bar_start", "open", "high", "low", "close")
    assert n1 == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # re-send one file under the same name, restart from the checkpoint: nothing new
    first = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))[0]
    os.utime(os.path.join(src, first))  # "sent again": same name, new modification time
    stream2 = T.parquet_stream(spark, src, schema=schema, max_files=1)
    T.run_to_files(T.stream_bars(quotes_from(stream2), "1 hour", "2 hours", seq="event_id"), "bars",
                   checkpoint=ck, out=out)
    assert spark.read.parquet(out).count() == n1


def test_late_ticks_inside_and_beyond_the_watermark(spark, scratch):
    schema = "symbol string, ts timestamp, price double, event_id long"
    src = os.path.join(scratch, "ticks")
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    # Spark drops late rows against the watermark of the previous micro-batch, so the late
    # file comes two batches after the jump
    batches = [
        [("A", t(0, 10), 1.0, 1), ("A", t(1, 10), 2.0, 2)],
        [("A", t(5, 0), 3.0, 3)],                      # watermark -> 03:00
        [("A", t(5, 10), 3.5, 7)],
        [("A", t(3, 30), 4.0, 4), ("A", t(0, 20), 9.0, 5)],   # 03:30 inside, 00:20 beyond
        [("A", t(9, 0), 5.0, 6)],                      # watermark -> 07:00: closes hours up to 07:00
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        _stamp_new(src, i)
    stream = T.parquet_stream(spark, src, schema=spark.read.parquet(src).schema, max_files=1)
    _, out = T.run_to_files(T.stream_bars(stream, "1 hour", "2 hours", seq="event_id"), "late",
                            checkpoint=os.path.join(scratch, "ck"), out=os.path.join(scratch, "o"))
    got = {r.bar_start.hour: (r.open, r.close, r.ticks) for r in spark.read.parquet(out).collect()}
    assert got[0] == (1.0, 1.0, 1)      # the 00:20 tick came after the watermark passed: dropped
    assert got[3] == (4.0, 4.0, 1)      # late but inside the watermark: kept
    assert 9 not in got                 # still open


def test_stream_news_equals_batch(spark, scratch):
    pages = T.table_stream(spark, SF_SMALL, "pages").select("page_id", "url")
    live = T.stream_unseen_news(news_from(pages), seen(spark, SF_SMALL))
    _, out = T.run_to_files(live.select("url"), "news", checkpoint=os.path.join(scratch, "ck"),
                            out=os.path.join(scratch, "o"))
    got = sorted(r.url for r in spark.read.parquet(out).collect())
    want = sorted(r.url for r in unseen(news(spark, SF_SMALL), seen(spark, SF_SMALL)).collect())
    assert got == want and len(got) == len(set(got))


def test_indicator_writer_replay_late_and_rejected(spark, scratch):
    from tickweave.functions.indicators import add_indicators
    from tickweave.sources.bars import daily_bars
    bars = daily_bars(spark, SF_SMALL).cache()
    sym = bars.select("symbol").first()[0]
    # hold back one recent bar of one symbol (late, but inside the tail) and one early bar
    # of that symbol (too late: far more than the look-back before the tail's end)
    dates = [r[0] for r in bars.filter(F.col("symbol") == sym).orderBy("date").select("date").collect()]
    recent, early = dates[-10], dates[5]
    late = (F.col("symbol") == sym) & (F.col("date") == recent)
    lost = (F.col("symbol") == sym) & (F.col("date") == early)
    body = bars.filter(~late & ~lost)
    cut = "1998-01-01"
    b1, b2 = body.filter(F.col("date") < cut), body.filter(F.col("date") >= cut)
    tail, out, rej = (os.path.join(scratch, n) for n in ("tail", "out", "rejected"))
    w = T.indicator_batch_writer(tail, out, price_scale=2, rejected=rej)
    w(b1, 0)
    w(b2, 1)
    w(b2, 1)                                   # replay of batch 1 after a failure
    w(bars.filter(late | lost), 2)             # the two held-back bars arrive late
    assert [(r.symbol, r.date) for r in spark.read.parquet(rej).collect()] == [(sym, early)]
    cur = T.current_indicators(spark, out).select("symbol", "date", "rsi", "ma200", "volatility")
    ref = add_indicators(bars.filter(~lost), price_scale=2).select("symbol", "date", "rsi", "ma200", "volatility")
    assert cur.count() == ref.count()
    assert cur.exceptAll(ref).count() == 0 and ref.exceptAll(cur).count() == 0


def test_latest_quote_and_alerts(spark, scratch):
    ev = T.table_stream(spark, SF_SMALL, "events")
    _, out = T.run_to_files(T.stream_latest_quote(quotes_from(ev)), "lq", mode="complete",
                            checkpoint=os.path.join(scratch, "ck"), out=os.path.join(scratch, "o"))
    got = {r.symbol: r.price for r in spark.read.parquet(out).collect()}
    q = quotes(spark, SF_SMALL)
    want = {r.symbol: r.p for r in q.groupBy("symbol").agg(F.max_by("price", "ts").alias("p")).collect()}
    assert got == want


def test_cadences():
    assert T.trigger_for("market") == {"processingTime": "30 seconds"}
    assert T.trigger_for("stock") == {"processingTime": "50 seconds"}
    assert T.trigger_for("flows") == {"processingTime": "300 seconds"}
    assert T.trigger_for(None) == {"availableNow": True}


def test_alerts_fire_once_across_batches_and_replays(spark, scratch):
    alerts = spark.createDataFrame([(1, "A", 10.0), (2, "A", 20.0), (3, "B", 5.0)],
                                   "alert_id long, symbol string, price double")
    out = os.path.join(scratch, "fired")
    w = T.alert_batch_writer(alerts, out)
    tick = "symbol string, price double"
    w(spark.createDataFrame([("A", 9.0), ("A", 12.0), ("B", 1.0)], tick), 0)    # fires 1
    w(spark.createDataFrame([("A", 15.0), ("A", 25.0)], tick), 1)                # fires 2 (1 already fired)
    w(spark.createDataFrame([("A", 15.0), ("A", 25.0)], tick), 1)                # replay
    w(spark.createDataFrame([("A", 30.0), ("B", 4.99)], tick), 2)                # nothing new
    got = sorted((r.alert_id, r.batch_id) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0), (2, 1)]


def test_exact_news_writer_first_in_feed_order_and_replay(spark, scratch):
    schema = "url string, feed_pos long, title string"
    seen = spark.createDataFrame([("s",)], "url string")
    out = os.path.join(scratch, "news")
    w = T.unseen_batch_writer(seen, out)
    w(spark.createDataFrame([("a", 3, "a-late"), ("a", 1, "a-first"), (None, 2, "n1"), ("s", 4, "seen")], schema), 0)
    w(spark.createDataFrame([("a", 5, "again"), (None, 6, "n2"), ("b", 7, "b")], schema), 1)
    w(spark.createDataFrame([("a", 5, "again"), (None, 6, "n2"), ("b", 7, "b")], schema), 1)  # replay
    got = sorted((r.url or "", r.title, r.batch_id) for r in spark.read.parquet(out).collect())
    assert got == [("", "n1", 0), ("a", "a-first", 0), ("b", "b", 1)]
