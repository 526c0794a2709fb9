"""W1-W7 against a plain computation of every row from its own slice of closes, on the sf0.001 bars and on
hand-made edge series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.functions.indicators import add_indicators
from tickweave.sources.bars import daily_bars

COLS = ["change", "daily_return", "rsi", "ma20", "ma50", "ma200", "volatility"]


def per_row_indicators(values) -> pd.DataFrame:
    """W1-W7 as SURVEY words them, row by row from slices of the closes; None where a window is not full or
    a divisor is 0."""
    closes = [None if v is None or math.isnan(v) else float(v) for v in values]

    def change(i):
        return None if i < 1 or closes[i] is None or closes[i - 1] is None else closes[i] - closes[i - 1]

    def daily(i):
        return None if change(i) is None or closes[i - 1] == 0 else closes[i] / closes[i - 1] - 1

    def last(f, i, n):
        """The n values of ``f`` up to row i, or None when one is missing."""
        found = [f(k) for k in range(i - n + 1, i + 1)] if i >= n - 1 else [None]
        return None if None in found else found

    def strength(i):
        moves = last(change, i, 14)
        falls = -sum(m for m in moves if m < 0) if moves else 0
        return None if not falls else 100 - 100 / (1 + sum(m for m in moves if m > 0) / falls)

    def spread(i):
        found = last(daily, i, 20)
        return None if found is None else float(np.std(found, ddof=1)) * math.sqrt(252)

    def mean(i, n):
        found = last(closes.__getitem__, i, n)
        return None if found is None else math.fsum(found) / n

    return pd.DataFrame([{"change": change(i), "daily_return": daily(i), "rsi": strength(i), "volatility": spread(i),
                          **{f"ma{n}": mean(i, n) for n in (20, 50, 200)}} for i in range(len(closes))], columns=COLS)


def _close(a, b, tol=1e-8):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return False
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def _check(spark_rows, close_values, cols=COLS):
    expected = per_row_indicators(pd.Series(close_values, dtype="float64"))
    assert len(spark_rows) == len(expected)
    for i, row in enumerate(spark_rows):
        for c in cols:
            e = expected[c].iloc[i]
            e = None if pd.isna(e) else float(e)
            assert _close(row[c], e), (i, c, row[c], e)


@pytest.mark.parametrize("price_scale", [None, 2])
def test_sf0001_bars_match_pandas(spark, price_scale):
    bars = daily_bars(spark, SF_SMALL)
    ind = add_indicators(bars, price_scale=price_scale).orderBy("symbol", "date").collect()
    by_sym = {}
    for r in ind:
        by_sym.setdefault(r["symbol"], []).append(r)
    assert len(by_sym) == 10
    for rows in by_sym.values():
        _check(rows, [r["close"] for r in rows])


def _series(spark, closes, symbol="S"):
    import datetime as dt
    d0 = dt.date(2024, 1, 1)
    data = [(symbol, d0 + dt.timedelta(days=i), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")


EDGE = {
    "one_row": [10.0],
    "fourteen": [10.0 + i for i in range(14)],
    "fifteen_mixed": [10.0, 11.0, 10.5, 12.0, 11.0, 13.0, 12.5, 12.0, 14.0, 13.0, 15.0, 14.0, 16.0, 15.0, 15.5],
    "nineteen": [20.0 + (i % 3) for i in range(19)],
    "twenty": [20.0 + (i % 4) * 0.25 for i in range(20)],
    "twenty_one": [20.0 + (i % 5) * 0.5 for i in range(21)],
    "two_fifty_one": [100.0 + math.sin(i) * 5 for i in range(251)],
    "constant": [50.0] * 40,
    "rising": [10.0 + i for i in range(40)],
    "falling": [100.0 - i for i in range(40)],
    "null_in_middle": [10.0 + i for i in range(10)] + [None] + [20.0 + i for i in range(25)],
    "zero_close": [10.0, 11.0, 0.0, 12.0] + [12.0 + (i % 3) for i in range(30)],
    "last_null": [10.0 + (i % 4) for i in range(30)] + [None],
}


@pytest.mark.parametrize("case", sorted(EDGE))
def test_edge_series(spark, case):
    closes = [None if v is None else round(v, 2) for v in EDGE[case]]
    df = _series(spark, closes)
    rows = add_indicators(df).orderBy("date").collect()
    _check(rows, [np.nan if v is None else v for v in closes])


def test_edge_rules_of_the_reference(spark):
    """RSI NULL for a constant or strictly rising series, 0 for a strictly falling one;
    volatility 0 for a constant price."""
    const = add_indicators(_series(spark, EDGE["constant"])).orderBy("date").collect()
    assert all(r["rsi"] is None for r in const)
    assert const[-1]["volatility"] == 0.0
    rising = add_indicators(_series(spark, EDGE["rising"])).orderBy("date").collect()
    assert all(r["rsi"] is None for r in rising)
    falling = add_indicators(_series(spark, EDGE["falling"])).orderBy("date").collect()
    assert [r["rsi"] for r in falling[:14]] == [None] * 14
    assert all(r["rsi"] == 0.0 for r in falling[14:])
    # first valid positions: RSI row 14, MA20 row 19, volatility row 20
    mixed = add_indicators(_series(spark, EDGE["two_fifty_one"])).orderBy("date").collect()
    first = lambda c: next(i for i, r in enumerate(mixed) if r[c] is not None)
    assert (first("rsi"), first("ma20"), first("ma200"), first("volatility")) == (14, 19, 199, 20)


def test_exact_and_frame_moving_averages_agree(spark):
    bars = daily_bars(spark, SF_SMALL)
    a = add_indicators(bars, price_scale=2).select("symbol", "date", *[F.col(f"ma{n}").alias(f"a{n}") for n in (20, 50, 200)])
    b = add_indicators(bars).select("symbol", "date", *[F.col(f"ma{n}").alias(f"b{n}") for n in (20, 50, 200)])
    j = a.join(b, ["symbol", "date"])
    worst = j.select(*[F.max(F.abs(F.col(f"a{n}") - F.col(f"b{n}"))).alias(f"d{n}") for n in (20, 50, 200)]).first()
    assert all(v < 1e-8 for v in worst)


@pytest.mark.parametrize("chunk", [201, 250])
def test_chunked_indicators_at_chunk_boundaries(spark, chunk):
    """Series whose lengths sit on and around the chunk edges (halo 200) give exactly the
    whole-series values when computed in halo chunks."""
    import datetime as dt
    d0 = dt.date(2020, 1, 1)
    rows = []
    for s, n in [("one", 1), ("short", 150), ("c_minus", chunk - 1), ("c", chunk), ("c_plus", chunk + 1),
                 ("long", 2 * chunk + 200)]:
        for i in range(n):
            c = round(100 + 10 * math.sin(i / 7.0) + (i % 5) * 0.37, 2)
            rows.append((s, d0 + dt.timedelta(days=i), c, c, c, c, 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, "
                                     "close double, volume double")
    whole = add_indicators(df, price_scale=2)
    parts = add_indicators(df, price_scale=2, chunk_rows=chunk)
    assert parts.count() == whole.count()
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_chunked_intraday_series_with_a_finer_bucket(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("X", t0 + dt.timedelta(minutes=i), round(100 + 3 * math.sin(i / 9.0), 2)) for i in range(700)]
    df = spark.createDataFrame([(s, t, c, c, c, c, 1.0) for s, t, c in rows],
                               "symbol string, ts timestamp, open double, high double, low double, close double, "
                               "volume double")
    whole = add_indicators(df, price_scale=2, order_col="ts")
    parts = add_indicators(df, price_scale=2, order_col="ts", chunk_rows=250,
                           chunk_bucket=F.date_trunc("hour", F.col("ts")))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
