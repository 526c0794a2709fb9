"""Hand-worked goldens for the scalar rules (F1-F5, F8)."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions.rules import action, business_days, risk_score, expected_change_pct, round_to_strike, \
    rsi_or_default, strike_text

# (price, nearest, up, down), worked out by hand from the reference's rule:
# step 0.5 / 1 / 5 / 100 below 10 / 100 / 500 / above; nearest by half-even; then one more step
# up when price mod step > step/2, one step down when < step/2.
STRIKES = [
    (9.99, 10.0, 10.5, 10.0),
    (10.0, 10.0, 10.0, 9.0),
    (12.5, 12.0, 12.0, 12.0),
    (13.5, 14.0, 14.0, 14.0),
    (99.5, 100.0, 100.0, 100.0),
    (100.0, 100.0, 100.0, 95.0),
    (102.5, 100.0, 100.0, 100.0),
    (107.5, 110.0, 110.0, 110.0),
    (499.9, 500.0, 505.0, 500.0),
    (500.0, 500.0, 500.0, 400.0),
    (1000.0, 1000.0, 1000.0, 900.0),
    (1030.0, 1000.0, 1000.0, 900.0),
    (1050.0, 1000.0, 1000.0, 1000.0),
    (1060.0, 1100.0, 1200.0, 1100.0),
]


def test_round_to_strike_goldens(spark):
    df = spark.createDataFrame([(p,) for p, *_ in STRIKES], "p double")
    got = df.select("p", round_to_strike(F.col("p")).alias("n"), round_to_strike(F.col("p"), "up").alias("u"),
                    round_to_strike(F.col("p"), "down").alias("d")).collect()
    assert [(r.p, r.n, r.u, r.d) for r in got] == STRIKES


def test_strike_text_like_the_reference_prints_it(spark):
    df = spark.createDataFrame([(9.99,), (9.5,), (57.2,), (1060.0,)], "p double")
    got = [r[0] for r in df.select(strike_text(F.col("p"), round_to_strike(F.col("p"), "up"))).collect()]
    assert got == ["10.5", "9.5", "57", "1200"]  # 9.5 is already on the 0.5 grid, remainder 0


def test_risk_score(spark):
    rows = [(2.0, 70.0, 3.0), (60.0, 50.0, 0.0), (0.0, 50.0, 0.0), (None, 50.0, 1.0), (1.0, None, 1.0),
            (1.0, 50.0, None), (0.0, 50.0, -1500.0)]
    df = spark.createDataFrame(rows, "m double, r double, c double")
    got = [r[0] for r in df.select(risk_score(F.col("m"), F.col("r"), F.col("c"))).collect()]
    assert got[0] == pytest.approx(100 - 4 - 8 - 0.3)
    assert got[1:3] == [0.0, 100.0]
    assert got[3:6] == [None, None, None]
    assert got[6] == 0.0


def test_action_branches(spark):
    rows = [
        (4.99, 2.01, 100.0),   # calls: strike(102, up) = 100
        (4.99, 2.0, 100.0),    # exactly +2: hold
        (4.99, -2.0, 100.0),   # exactly -2: hold
        (4.99, -2.01, 100.0),  # puts: strike(98, down) = 97
        (5.0, 10.0, 100.0),    # MAPE exactly 5: unreliable
        (1.0, None, 100.0),    # NULL change: unreliable (the reference would pick puts on NaN)
        (None, 3.0, 100.0),    # NULL MAPE: unreliable
        (1.0, 3.0, 9.0),       # calls on a small price: strike(9.18, up) = 9.0 -> "9.0"
    ]
    df = spark.createDataFrame(rows, "m double, c double, p double")
    text, strike = action(F.col("m"), F.col("c"), F.col("p"))
    got = [(r[0], r[1]) for r in df.select(text, strike).collect()]
    assert got == [
        ("Buy Calls ~₹100", 100.0),
        ("Hold / Avoid Options", None),
        ("Hold / Avoid Options", None),
        ("Buy Puts ~₹97", 97.0),
        ("Unreliable - Avoid Trades", None),
        ("Unreliable - Avoid Trades", None),
        ("Unreliable - Avoid Trades", None),
        ("Buy Calls ~₹9.0", 9.0),
    ]


def test_expected_change_and_rsi_default(spark):
    df = spark.createDataFrame([(110.0, 100.0, None), (90.0, 0.0, 30.0)], "f double, c double, r double")
    got = df.select(expected_change_pct(F.col("f"), F.col("c")), rsi_or_default(F.col("r"))).collect()
    assert got[0][0] == pytest.approx(10.0) and got[0][1] == 50.0
    assert got[1][0] is None and got[1][1] == 30.0


@pytest.mark.parametrize("start", [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(7)])
def test_business_days_equal_pandas(spark, start):
    df = spark.createDataFrame([(start,)], "d date")
    got = df.select(business_days(F.col("d"))).first()[0]
    want = [x.date() for x in pd.bdate_range(start=pd.Timestamp(start) + pd.Timedelta(days=1), periods=30)]
    assert got == want


def test_fixed_text_rounds_like_python_format(spark):
    from tickweave.functions.formatting import fixed, int_text, money
    vals = [0.125, 0.375, 2.675, 1.005, -1234.565, 1234567.891, 0.0, -0.004, 99.995]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(fixed(F.col("x")).alias("f"), money(F.col("x")).alias("m"), fixed(F.col("x"), 4).alias("f4")).collect()
    assert [r.f for r in got] == [f"{v:.2f}" for v in vals]
    assert [r.m for r in got] == [f"{v:,.2f}" for v in vals]
    assert [r.f4 for r in got] == [f"{v:.4f}" for v in vals]
    vols = spark.createDataFrame([(1234567.9,), (999.99,)], "v double").select(int_text(F.col("v"))).collect()
    assert [r[0] for r in vols] == [f"{int(1234567.9):,}", f"{int(999.99):,}"]
