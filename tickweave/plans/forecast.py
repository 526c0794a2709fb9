"""Forecasting on Spark: per-series min-max scaling (F7, A5), look-back samples (W8) and the
chronological split (W9), an AR(1) baseline fitted per symbol with one grouped aggregate
(A7), the pooled look-back regression (M1), test predictions (M2, M5) with MAE/MAPE (A4),
and the 30-step recursive forecast (M3) as rows (M4).

Nothing is collected to the driver except the pooled model's L+1 coefficients; the recursion
runs per symbol inside the JVM with the higher-order ``aggregate`` function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave import constants as K
from tickweave.functions.rules import business_days
from tickweave.operators.series import chronological_split, lag_windows, series_min_max, tail


def with_min_max(bars: DataFrame, value: str = "close") -> DataFrame:
    """Per-series min and max of ``value`` as columns.  [A5]  A window over the whole symbol
    partition, so the rows stay in place and no join is needed."""
    w = Window.partitionBy("symbol")
    return bars.withColumn("s_min", F.min(value).over(w)).withColumn("s_max", F.max(value).over(w))


def scale(c: Column, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min); 0 for a constant series.  [F7]"""
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def unscale(c: Column, lo: Column, hi: Column) -> Column:
    """Inverse of :func:`scale`.  [F7]"""
    return c * (hi - lo) + lo


def samples(bars: DataFrame, look_back: int = K.DEFAULT_LOOK_BACK, train_fraction: float = K.TRAIN_FRACTION,
            with_features: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """Scaled closes -> look-back samples with ``is_train``.  The scaler is fitted on the whole
    series, test part included, as in the reference.  [F7, W8, W9]

    Every sample carries ``prev`` (the newest look-back value).  ``with_features=False`` skips
    building the ``look_back``-long arrays — the AR(1) baseline only needs ``prev`` — and
    keeps the same sample set by counting the window instead."""
    if chunk_rows:
        return _samples_chunked(bars, look_back, train_fraction, with_features, chunk_rows)
    sc = with_min_max(bars).withColumn("scaled", scale(F.col("close"), F.col("s_min"), F.col("s_max")))
    if with_features:
        s = lag_windows(sc, "scaled", look_back).withColumn("prev", F.element_at("features", -1))
    else:
        from tickweave.functions.indicators import series_window
        lo, hi = K.LOOK_BACK_RANGE
        if not lo <= look_back <= hi:
            raise ValueError(f"look_back must be in {lo}..{hi}")
        w = series_window()
        s = sc.select("*", F.lag("scaled").over(w).alias("prev"),
                      F.count("scaled").over(w.rowsBetween(-look_back, -1)).alias("_nw")) \
            .withColumn("label", F.col("scaled")).filter(F.col("_nw") == look_back).drop("_nw")
    return chronological_split(s, train_fraction)


def _samples_chunked(bars: DataFrame, look_back: int, train_fraction: float, with_features: bool,
                     chunk_rows: int) -> DataFrame:
    """:func:`samples` without any task holding a whole series: min/max come from a per-symbol
    aggregate, the look-back windows run on halo chunks, and sample positions and counts come
    from :func:`tickweave.operators.series.series_index` over the kept samples."""
    from tickweave.functions.indicators import series_window
    from tickweave.operators.series import series_chunks, series_index
    from tickweave.session import materialize_table
    lo, hi = K.LOOK_BACK_RANGE
    if not lo <= look_back <= hi:
        raise ValueError(f"look_back must be in {lo}..{hi}")
    # windows and positions run on the closes: the scale is a symbol's own, so values are scaled at the end
    ch = series_chunks(bars, look_back, max(int(chunk_rows), look_back))
    w = series_window(("symbol", "_chunk"))
    frame = w.rowsBetween(-look_back, -1)
    extra = [F.collect_list("close").over(frame).alias("features")] if with_features else []
    s = ch.select("*", F.lag("close").over(w).alias("prev"), F.count("close").over(frame).alias("_nw"), *extra)
    s = (s.filter(~F.col("_halo") & (F.col("_nw") == look_back))
         .drop("_chunk", "_halo", "series_idx", "series_len", "_nw"))
    s = series_index(materialize_table(s, "chunked-samples"))  # read twice: rows and their counts
    mm = series_min_max(bars).withColumnRenamed("symbol", "_mm_symbol")
    s = s.join(mm, s["symbol"].eqNullSafe(mm["_mm_symbol"])).drop("_mm_symbol")
    scaled = lambda c: scale(c, F.col("s_min"), F.col("s_max"))
    s = s.withColumns({"scaled": scaled(F.col("close")), "prev": scaled(F.col("prev")), "label": scaled(F.col("close")),
                       **({"features": F.transform("features", scaled)} if with_features else {})})
    return (s.withColumnRenamed("series_idx", "sample_idx")
            .withColumn("is_train", F.col("sample_idx") < F.floor(F.col("series_len") * F.lit(train_fraction)))
            .drop("series_len"))


def fit_ar1(samples_df: DataFrame) -> DataFrame:
    """Per-symbol AR(1) on the training samples: label = a + b * previous scaled close.  [A7]

    ``regr_slope``/``regr_intercept`` are ordinary aggregates with a partial phase, so each
    symbol's fit is a few running sums, whatever the symbol's size."""
    prev = F.col("prev")
    return (
        samples_df.filter("is_train")
        .groupBy("symbol")
        .agg(F.regr_intercept("label", prev).alias("ar_a"), F.regr_slope("label", prev).alias("ar_b"))
    )


def predict_test_ar1(samples_df: DataFrame, coef: DataFrame) -> DataFrame:
    """One-step predictions on the test samples, back in price units.  [M2, M5]

    Every test row keeps its own date, so actual and predicted line up without re-indexing."""
    prev = F.col("prev")
    t = samples_df.filter(~F.col("is_train")).join(coef, "symbol")
    pred_scaled = F.col("ar_a") + F.col("ar_b") * prev
    return t.select(
        "symbol", "date", F.col("sample_idx").cast("long").alias("sample_idx"),
        F.col("close").alias("actual"),
        unscale(pred_scaled, F.col("s_min"), F.col("s_max")).alias("predicted"),
    )


def predict_test_last_value(samples_df: DataFrame) -> DataFrame:
    """The naive baseline on the same test samples: tomorrow's close = today's close."""
    return samples_df.filter(~F.col("is_train")).select(
        "symbol", "date", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("close").alias("actual"),
        unscale(F.col("prev"), F.col("s_min"), F.col("s_max")).alias("predicted"))


def metrics(pred: DataFrame) -> DataFrame:
    """MAE and MAPE (in %) of the test predictions; zero actuals are left out of the MAPE
    instead of making it infinite.  [A4]"""
    err = F.abs(F.col("actual") - F.col("predicted"))
    return pred.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(err).alias("mae"),
        (F.avg(F.abs(F.try_divide(F.col("actual") - F.col("predicted"), F.col("actual")))) * F.lit(100.0)).alias("mape"),
    )


def last_state(bars: DataFrame, look_back: int) -> DataFrame:
    """Per symbol: last date, last close, min/max and the last ``look_back`` scaled closes in
    time order (a bounded array: ``look_back`` values per symbol)."""
    mm = series_min_max(bars).withColumnRenamed("symbol", "_mm_symbol")
    # the cut is a WindowGroupLimit before the exchange: a symbol's older bars only pass the aggregate
    last = tail(bars.select("symbol", "date", "close"), look_back)
    rows = last.join(mm, last["symbol"].eqNullSafe(mm["_mm_symbol"])).withColumn("scaled", scale(F.col("close"), F.col("s_min"), F.col("s_max")))
    return rows.groupBy("symbol").agg(
        F.max("date").alias("last_date"),
        F.max_by("close", "date").alias("last_close"),
        F.max("s_min").alias("s_min"), F.max("s_max").alias("s_max"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "scaled"))), lambda x: x["scaled"]).alias("history"),
        F.count(F.lit(1)).alias("n_hist"),
    )


def last_state_ar1(frame: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Per symbol: last date, last close, min/max and the last scaled close as a one-element
    history — all the AR(1) recursion needs.  A plain aggregate (no window, no sort); on a
    frame already partitioned by symbol it adds no shuffle.  ``extra`` columns are taken from
    the last row too (``last_<name>``)."""
    lo = F.min("s_min") if "s_min" in frame.columns else F.min("close")
    hi = F.max("s_max") if "s_max" in frame.columns else F.max("close")
    g = frame.groupBy("symbol").agg(
        F.max("date").alias("last_date"),
        F.max_by("close", "date").alias("last_close"),
        lo.alias("s_min"), hi.alias("s_max"),
        *[F.max_by(c, "date").alias(f"last_{c}") for c in extra],
    )
    h0 = scale(F.col("last_close"), F.col("s_min"), F.col("s_max"))
    return g.withColumn("history", F.array(h0)).withColumn("n_hist", F.lit(1))


def recursive_forecast_ar1(state: DataFrame, coef: DataFrame, steps: int = K.FORECAST_STEPS) -> DataFrame:
    """Predict, append, repeat: ``steps`` values per symbol from the last scaled close.  [M3]

    ``aggregate(sequence(1, steps), [h0], (acc, i) -> acc || [a + b * acc[-1]])`` runs the
    loop inside one row, so 10 000 symbols are 10 000 independent rows, not a driver loop."""
    j = state.join(coef, "symbol")
    h0 = F.element_at("history", -1)
    acc = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.array(h0),
        lambda a, i: F.concat(a, F.array(F.col("ar_a") + F.col("ar_b") * F.element_at(a, -1))),
    )
    scaled_path = F.slice(acc, 2, steps)
    prices = F.transform(scaled_path, lambda h: unscale(h, F.col("s_min"), F.col("s_max")))
    return j.select("symbol", "last_date", "last_close", prices.alias("prices"),
                    business_days(F.col("last_date"), steps).alias("dates"))


def forecast_table(fc: DataFrame) -> DataFrame:
    """``(symbol, step, date, price)``, one row per forecast day.  [M4]"""
    z = fc.select("symbol", F.posexplode(F.arrays_zip(F.col("dates").alias("date"), F.col("prices").alias("price"))))
    return z.select("symbol", (F.col("pos") + 1).cast("long").alias("step"), F.col("col.date").alias("date"),
                    F.col("col.price").alias("price"))


# ---------------------------------------------------------------------------------------------
# Pooled look-back regression (M1): one model over the look-back vectors of every symbol.
# ---------------------------------------------------------------------------------------------

def fit_pooled(samples_df: DataFrame, max_iter: int = K.DEFAULT_EPOCHS, reg: float = 0.0):
    """One ``LinearRegression`` on the scaled look-back vectors of all symbols' training
    samples.  [M1]  It replaces the reference's one network per symbol: same inputs, label,
    split and metrics, a different (linear) model.  ``max_iter`` takes the epochs setting
    (5..100).  With L <= 60 features Spark solves the normal equations in one distributed pass
    (a treeAggregate of the L x L Gram matrix); only L + 1 numbers come back to the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    lo, hi = K.EPOCHS_RANGE
    if not lo <= max_iter <= hi:
        raise ValueError(f"epochs must be in {lo}..{hi}")
    train = samples_df.filter("is_train").select(array_to_vector("features").alias("fv"), "label")
    lr = LinearRegression(featuresCol="fv", labelCol="label", maxIter=max_iter, regParam=reg,
                          solver="normal", standardization=False)
    return lr.fit(train)


def pooled_coefficients(model) -> tuple[float, list[float]]:
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def _dot(hist: Column, coef: list[float], look_back: int) -> Column:
    window = F.slice(hist, -look_back, look_back)
    cs = F.array(*[F.lit(c) for c in coef])
    return F.aggregate(F.zip_with(window, cs, lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)


def predict_test_pooled(samples_df: DataFrame, intercept: float, coef: list[float]) -> DataFrame:
    """Pooled-model predictions on the test samples, in price units.  [M2, M5]"""
    L = len(coef)
    pred_scaled = F.lit(intercept) + _dot(F.col("features"), coef, L)
    return samples_df.filter(~F.col("is_train")).select(
        "symbol", "date", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("close").alias("actual"),
        unscale(pred_scaled, F.col("s_min"), F.col("s_max")).alias("predicted"))


def recursive_forecast_pooled(state: DataFrame, intercept: float, coef: list[float],
                              steps: int = K.FORECAST_STEPS) -> DataFrame:
    """The 30-step loop of the reference with the pooled model: the window slides over its own
    predictions.  [M3]  Symbols with fewer than L bars get no forecast."""
    L = len(coef)
    acc = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.col("history"),
        lambda a, i: F.concat(a, F.array(F.lit(intercept) + _dot(a, coef, L))),
    )
    path = F.slice(acc, -steps, steps)
    prices = F.transform(path, lambda h: unscale(h, F.col("s_min"), F.col("s_max")))
    return state.filter(F.col("n_hist") == L).select(
        "symbol", "last_date", "last_close", prices.alias("prices"),
        business_days(F.col("last_date"), steps).alias("dates"))


# ---------------------------------------------------------------------------------------------
# Tree option for the pooled model (M1 with GBTRegressor): predictions come from the model's
# transform, so the 30-step recursion runs as 30 distributed transforms over one row per symbol.
# ---------------------------------------------------------------------------------------------

def fit_pooled_gbt(samples_df: DataFrame, max_iter: int = K.DEFAULT_EPOCHS, max_depth: int = 4, seed: int = 42):
    """Gradient-boosted trees on the scaled look-back vectors of all symbols' training samples
    (``max_iter`` takes the epochs setting, 5..100).  [M1, option]"""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    lo, hi = K.EPOCHS_RANGE
    if not lo <= max_iter <= hi:
        raise ValueError(f"epochs must be in {lo}..{hi}")
    train = samples_df.filter("is_train").select(array_to_vector("features").alias("fv"), "label")
    return GBTRegressor(featuresCol="fv", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(train)


def predict_test_model(samples_df: DataFrame, model) -> DataFrame:
    """Test-sample predictions of a fitted Spark ML model, in price units.  [M2, M5]"""
    from pyspark.ml.functions import array_to_vector
    t = samples_df.filter(~F.col("is_train")).withColumn("fv", array_to_vector("features"))
    return model.transform(t).select(
        "symbol", "date", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("close").alias("actual"),
        unscale(F.col("prediction"), F.col("s_min"), F.col("s_max")).alias("predicted"))


def recursive_forecast_model(state: DataFrame, model, look_back: int, steps: int = K.FORECAST_STEPS,
                             checkpoint_every: int = 10) -> DataFrame:
    """Predict, append, repeat with any fitted Spark ML model.  [M3]

    Each step is one distributed ``transform`` of a frame with one row per symbol; the loop on
    the driver only chains the steps (no data comes back).  The frame is checkpointed every
    ``checkpoint_every`` steps so the plan and its lineage stay short."""
    from pyspark.ml.functions import array_to_vector
    from tickweave.session import materialize

    cur = state.filter(F.col("n_hist") == look_back).select(
        "symbol", "last_date", "last_close", "s_min", "s_max", "history",
        F.array().cast("array<double>").alias("path"))
    for step in range(1, steps + 1):
        x = cur.withColumn("fv", array_to_vector(F.slice("history", -look_back, look_back)))
        cur = (model.transform(x)
               .withColumn("history", F.concat("history", F.array("prediction")))
               .withColumn("path", F.concat("path", F.array("prediction")))
               .drop("fv", "prediction"))
        if checkpoint_every and step % checkpoint_every == 0 and step < steps:
            cur = materialize(cur)
    prices = F.transform("path", lambda h: unscale(h, F.col("s_min"), F.col("s_max")))
    return cur.select("symbol", "last_date", "last_close", prices.alias("prices"),
                      business_days(F.col("last_date"), steps).alias("dates"))
