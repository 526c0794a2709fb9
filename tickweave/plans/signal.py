"""End-to-end trade signal per symbol (entry point E3): scale -> samples -> split -> fit ->
test metrics -> 30-step forecast -> expected change, RSI, risk score and action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave import constants as K
from tickweave.functions.indicators import add_indicators
from tickweave.functions.rules import action, risk_score, expected_change_pct, rsi_or_default
from tickweave.operators.series import latest
from tickweave.plans import forecast as FC
from tickweave.session import materialize, materialize_table


def signal_inputs(mets: DataFrame, fc: DataFrame, last_rsi: DataFrame) -> DataFrame:
    """Per symbol: MAPE, MAE, last forecast, last close and last RSI side by side.  [J3]

    All three inputs have one row per symbol; RSI is a left join so its default applies.
    When the inputs come from one frame partitioned by symbol, these joins need no shuffle."""
    return (
        mets.join(fc.select("symbol", "last_date", "last_close",
                            F.element_at("prices", -1).alias("last_forecast")), "symbol")
        .join(last_rsi.select("symbol", "last_rsi"), "symbol", "left")
    )


def apply_rules(inputs: DataFrame) -> DataFrame:
    """F4, F5, F1 and F3 on the joined inputs."""
    chg = expected_change_pct(F.col("last_forecast"), F.col("last_close"))
    df = inputs.withColumn("change_pct", chg).withColumn("rsi_used", rsi_or_default(F.col("last_rsi")))
    text, strike = action(F.col("mape"), F.col("change_pct"), F.col("last_close"))
    return (
        df.withColumn("risk_score", risk_score(F.col("mape"), F.col("rsi_used"), F.col("change_pct")))
        .withColumn("action", text)
        .withColumn("strike", strike)
    )


def ar1_signal(bars: DataFrame, look_back: int = K.DEFAULT_LOOK_BACK, steps: int = K.FORECAST_STEPS,
               price_scale: int | None = None, checkpoint: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """The whole E3 procedure with the per-symbol AR(1) baseline.

    Plan: the indicators, the scaler, the samples and the split are window columns over one
    ``symbol`` partitioning (one Exchange + Sort of the bars).  That frame is read by four
    branches (fit, test metrics, last state, last RSI); it is written once as Parquet
    (``checkpoint``), so they do not each re-sort and re-run the windows, each reads the columns it
    uses only, and the lineage back to the raw trades is cut.
    The branches are per-symbol aggregates and one-row-per-symbol joins."""
    if chunk_rows and checkpoint:  # positions in a series take two readings of what is cut: written, not computed twice
        bars = materialize_table(bars.select("symbol", "date", "close"), "signal-bars")
    ind = add_indicators(bars, price_scale=price_scale, ma_windows=(), chunk_rows=chunk_rows)
    if chunk_rows and checkpoint:
        ind = materialize_table(ind.select("symbol", "date", "close", "rsi"), "signal-indicators")
    smp = FC.samples(ind, look_back, with_features=False, chunk_rows=chunk_rows).select(
        "symbol", "date", "close", "rsi", "s_min", "s_max", "prev", "label", "sample_idx", "is_train")
    if checkpoint:
        smp = materialize_table(smp, "signal-samples")
    coef = FC.fit_ar1(smp)
    mets = FC.metrics(FC.predict_test_ar1(smp, coef))
    state = FC.last_state_ar1(smp, ["rsi"])
    fc = FC.recursive_forecast_ar1(state, coef, steps)
    return apply_rules(signal_inputs(mets, fc, state))


def pooled_signal(bars: DataFrame, look_back: int = K.DEFAULT_LOOK_BACK, steps: int = K.FORECAST_STEPS,
                  epochs: int = K.DEFAULT_EPOCHS, model: str = "linear") -> DataFrame:
    """The E3 procedure with one pooled model over all symbols (M1): ``model="linear"``
    (``LinearRegression``; the recursion runs on its coefficients inside one row per symbol)
    or ``model="gbt"`` (``GBTRegressor``; the recursion is 30 distributed transforms)."""
    smp = FC.samples(bars, look_back)
    smp = materialize(smp)  # read by the fit, the test predictions and nothing else twice
    state = FC.last_state(bars, look_back)
    if model == "gbt":
        m = FC.fit_pooled_gbt(smp, max_iter=epochs)
        mets = FC.metrics(FC.predict_test_model(smp, m))
        fc = FC.recursive_forecast_model(state, m, look_back, steps)
    else:
        m = FC.fit_pooled(smp, max_iter=epochs)
        b0, coef = FC.pooled_coefficients(m)
        mets = FC.metrics(FC.predict_test_pooled(smp, b0, coef))
        fc = FC.recursive_forecast_pooled(state, b0, coef, steps)
    last_rsi = latest(add_indicators(bars, ma_windows=()), ["rsi"])
    return apply_rules(signal_inputs(mets, fc, last_rsi))
