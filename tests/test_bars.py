"""Bars from trades with any tie-break: against a plain per-row computation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.sources import bars as B

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "sym string, at {}, px double, n double, venue string, no decimal(30,0)"


def trades(ties: bool, seed: int = 3):
    """(symbol, time, price, size, venue, number) with times that repeat within a day, or never."""
    r, out = random.Random(seed), []
    for k in range(600):
        at = DAY + dt.timedelta(hours=r.randrange(60) if ties else 0, microseconds=0 if ties else k * 400_000_123)
        out.append((r.choice(["A", "B", None]), at, float(r.randrange(1000)), 1.0, r.choice("xyz"), 10 ** 25 + r.randrange(10 ** 24)))
    return out


def by_hand(rows):
    days = {}
    for row in rows:
        days.setdefault((row[0], row[1].date()), []).append(row)
    out = set()
    for (sym, day), part in days.items():
        part = sorted(part, key=lambda x: (x[1], x[4], x[5]))
        px = [x[2] for x in part]
        out.add((sym, day, px[0], max(px), min(px), px[-1], float(len(px))))
    return out


def built(df):
    got = B.build_bars(df, symbol="sym", ts="at", price="px", qty="n", seq=["venue", "no"])
    rows = [tuple(x) for x in got.select("symbol", "date", "open", "high", "low", "close", "volume").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_any_tie_break(spark, monkeypatch, kind, ties, limit):
    """Text and 26-digit tie-breaks, with few ties (broadcast) and beyond the bound (joined by a shuffle)."""
    from decimal import Decimal
    monkeypatch.setattr(B, "BROADCAST_TIES", limit)
    rows = trades(ties)
    data = [(*x[:5], Decimal(x[5])) for x in rows]
    assert built(spark.createDataFrame(data, SCHEMA.format(kind))) == by_hand(rows)


def test_no_trades_give_no_bars(spark):
    assert built(spark.createDataFrame([], SCHEMA.format("timestamp"))) == set()


def test_times_before_1970_and_missing_times(spark):
    from decimal import Decimal
    early = dt.datetime(1950, 1, 2)
    data = [("A", early + dt.timedelta(hours=h), float(h), 1.0, "x", Decimal(1)) for h in range(5)]
    data += [("A", None, 7.0, 1.0, "b", Decimal(1)), ("A", None, 8.0, 1.0, "a", Decimal(1))]
    assert built(spark.createDataFrame(data, SCHEMA.format("timestamp"))) == {
        ("A", early.date(), 0.0, 4.0, 0.0, 4.0, 5.0), ("A", None, 8.0, 8.0, 7.0, 7.0, 2.0)}


def test_first_pass_sorts_no_trades(spark, monkeypatch):
    """The pass over all trades is a hash aggregate; without ties it is the only one."""
    from decimal import Decimal
    from tickweave import session
    plans, write = [], session.materialize_table

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(session, "materialize_table", seen)
    df = spark.createDataFrame([(*x[:5], Decimal(x[5])) for x in trades(False)], SCHEMA.format("timestamp"))
    out = B.build_bars(df, symbol="sym", ts="at", price="px", qty="n", seq=["venue", "no"])
    assert len(plans) == 1 and "SortAggregate" not in plans[0] and "HashAggregate" in plans[0]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_tie_break_columns_equal_the_packed_key(spark):
    """The test data's day-long ties, by columns as by the packed key."""
    a = B.build_bars(B.lineitem_trades(spark, SF_SMALL), seq=B.LINEITEM_SEQ)
    b = B.daily_bars(spark, SF_SMALL).select(*a.columns)
    assert a.withColumn("volume", F.col("volume").cast("double")).exceptAll(b).count() == 0 and a.count() == b.count()


def test_bars_of_one_trade_are_exchanged_once(spark, monkeypatch):
    """With ties settled by a shuffle, only bars of several trades meet their settled ends."""
    from tickweave import session
    kept, write = [], session.materialize_table
    monkeypatch.setattr(session, "materialize_table", lambda df, name: (kept.append(write(df, name)), kept[-1])[1])
    monkeypatch.setattr(B, "BROADCAST_TIES", 0)
    day = dt.datetime(2024, 3, 1)
    data = [(f"S{k}", day, float(k), 1.0, k) for k in range(50)] + [("S1", day, 9.0, 1.0, 7), (None, day, 2.0, 1.0, 1), (None, day, 3.0, 1.0, 0)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp, price double, qty double, no long")
    got = {r.symbol: (r.open, r.high, r.low, r.close, r.volume) for r in B.build_bars(df, seq=["no"]).collect()}
    assert got[None] == (3.0, 3.0, 2.0, 2.0, 2.0) and got["S1"] == (1.0, 9.0, 1.0, 9.0, 2.0) and got["S7"] == (7.0, 7.0, 7.0, 7.0, 1.0) and len(got) == 51
    assert not any(t.startswith("decimal") for _, t in kept[0].dtypes)  # the first pass exchanges plain numbers
    plan = B.build_bars(df, seq=["no"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "(_n#" in plan
