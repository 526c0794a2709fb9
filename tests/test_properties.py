"""Property tests (hypothesis): value ranges, order and symbol independence, round trips."""

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickweave.functions.indicators import add_indicators
from tickweave.functions.rules import risk_score
from tickweave.operators.portfolio import holding_pnl, portfolio_totals
from tickweave.plans.forecast import scale, unscale

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cents = st.integers(min_value=1, max_value=10_000_000).map(lambda c: c / 100)


def _bars(spark, rows):
    d0 = dt.date(2020, 1, 1)
    data = [(s, d0 + dt.timedelta(days=i), c, c, c, c, 1.0) for s, i, c in rows]
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")


@SETTINGS
@given(st.lists(cents, min_size=1, max_size=60))
def test_rsi_bounded_and_order_free(spark, closes):
    rows = [("S", i, c) for i, c in enumerate(closes)]
    shuffled = rows[:]
    random.Random(len(rows)).shuffle(shuffled)
    a = add_indicators(_bars(spark, rows), price_scale=2).orderBy("date").collect()
    b = add_indicators(_bars(spark, shuffled).repartition(3), price_scale=2).orderBy("date").collect()
    assert a == b
    for r in a:
        assert r.rsi is None or 0.0 <= r.rsi <= 100.0
        assert r.volatility is None or r.volatility >= 0.0


@SETTINGS
@given(st.lists(cents, min_size=1, max_size=40), st.lists(cents, min_size=1, max_size=40))
def test_adding_a_symbol_does_not_change_others(spark, xs, ys):
    one = add_indicators(_bars(spark, [("X", i, c) for i, c in enumerate(xs)])).collect()
    both = add_indicators(_bars(spark, [("X", i, c) for i, c in enumerate(xs)] +
                                [("Y", i, c) for i, c in enumerate(ys)])).filter("symbol = 'X'").collect()
    assert sorted(one) == sorted(both)


@SETTINGS
@given(st.floats(0, 500, allow_nan=False), st.floats(0, 100, allow_nan=False),
       st.floats(-1000, 1000, allow_nan=False))
def test_risk_score_in_range(spark, m, r, c):
    df = spark.createDataFrame([(m, r, c)], "m double, r double, c double")
    v = df.select(risk_score(F.col("m"), F.col("r"), F.col("c"))).first()[0]
    assert 0.0 <= v <= 100.0


@SETTINGS
@given(st.lists(cents, min_size=1, max_size=30))
def test_unscale_inverts_scale(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lo, hi = min(xs), max(xs)
    s = scale(F.col("x"), F.lit(lo), F.lit(hi))
    got = df.select("x", s.alias("s"), unscale(s, F.lit(lo), F.lit(hi)).alias("back")).collect()
    for r in got:
        assert 0.0 <= r.s <= 1.0
        if hi > lo:
            assert abs(r.back - r.x) <= 1e-9 * max(1.0, abs(r.x))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 100).map(float), cents, cents), min_size=1, max_size=20))
def test_total_pnl_is_value_minus_cost(spark, rows):
    df = spark.createDataFrame(rows, "portfolio_id long, quantity double, buy_price double, current_price double")
    for r in portfolio_totals(holding_pnl(df)).collect():
        assert abs(r.total_pnl - (r.total_value - r.total_cost)) <= 1e-6 * max(1.0, r.total_value)
