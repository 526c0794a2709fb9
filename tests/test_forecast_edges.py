"""Edge series through the whole AR(1) signal: constant prices (scaling range 0), a series no
longer than the look-back (no samples), a zero close (left out of MAPE)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tickweave.plans import forecast as FC
from tickweave.plans.signal import ar1_signal


def _bars(spark, series):
    d0 = dt.date(2021, 1, 1)
    rows = [(s, d0 + dt.timedelta(days=i), c, c, c, c, 1.0) for s, cs in series.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")


def test_signal_edges(spark):
    wave = [100 + 5 * math.sin(i / 5) for i in range(120)]
    zero = [50.0 + (i % 7) for i in range(120)]
    zero[100] = 0.0
    b = _bars(spark, {"CONST": [42.0] * 120, "SHORT": [10.0 + i for i in range(30)], "WAVE": wave, "ZERO": zero})
    sig = {r.symbol: r for r in ar1_signal(b, look_back=30).collect()}
    # a series of look-back length has no samples, hence no fit and no signal row
    assert "SHORT" not in sig
    # constant series: scaled to 0, slope undefined -> no forecast -> no reliable action
    assert "CONST" not in sig or sig["CONST"].action == "Unreliable - Avoid Trades"
    assert sig["WAVE"].mape is not None and sig["WAVE"].risk_score is not None
    assert 0.0 <= sig["WAVE"].risk_score <= 100.0
    # the zero close is left out of MAPE instead of making it infinite
    assert sig["ZERO"].mape is not None and math.isfinite(sig["ZERO"].mape)


def test_scaler_and_samples_on_constant_and_short_series(spark):
    b = _bars(spark, {"CONST": [42.0] * 40, "SHORT": [1.0, 2.0, 3.0]})
    smp = FC.samples(b, 30)
    got = smp.groupBy("symbol").agg(F.count("*").alias("n"), F.max("label").alias("mx")).collect()
    assert [(r.symbol, r.n, r.mx) for r in got] == [("CONST", 10, 0.0)]
    assert smp.filter("is_train").count() == 8  # int(10 * 0.8)


def test_tree_model_option_runs_the_whole_procedure(spark):
    from conftest import SF_SMALL
    from tickweave.plans.signal import pooled_signal
    from tickweave.sources.bars import daily_bars, smooth_bars
    b = smooth_bars(daily_bars(spark, SF_SMALL))
    sig = pooled_signal(b, look_back=30, epochs=5, model="gbt").collect()
    assert len(sig) == 10
    for r in sig:
        assert r.mape is not None and r.mape < 10
        assert r.action  # one of the four texts
        assert r.risk_score is None or 0 <= r.risk_score <= 100
    lin = {r.symbol: r.last_forecast for r in pooled_signal(b, look_back=30).collect()}
    assert set(lin) == {r.symbol for r in sig}
