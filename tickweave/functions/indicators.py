"""Per-series indicator expressions (W1-W7), all over one window spec.

Every column is a built-in Column expression evaluated by Spark's Window operator inside the
JVM; there is no UDF.  All indicators of a frame share ``partitionBy(symbol).orderBy(date)``,
so Catalyst plans a single Exchange + Sort for the lot, whatever the number of columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave import constants as K


def series_window(partition_cols=("symbol",), order_col: str = "date"):
    """The one window spec of the engine: each symbol's rows in time order."""
    return Window.partitionBy(*partition_cols).orderBy(order_col)


def rows_frame(w, n: int):
    """The last ``n`` rows up to and including the current one."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def diff(c: Column, w) -> Column:
    """x[t] - x[t-1]; the first row is NULL.  [W1]"""
    return c - F.lag(c).over(w)


def pct_change(c: Column, prev: Column) -> Column:
    """x[t] / x[t-1] - 1; NULL on the first row and where the previous value is 0.  [W2]"""
    return F.try_divide(c, prev) - F.lit(1.0)


def gain(d: Column) -> Column:
    """max(d, 0), NULL stays NULL.  [W3]"""
    return F.when(d.isNull(), F.lit(None).cast("double")).when(d > 0, d).otherwise(F.lit(0.0))


def loss(d: Column) -> Column:
    """-min(d, 0), NULL stays NULL.  [W3]"""
    return F.when(d.isNull(), F.lit(None).cast("double")).when(d < 0, -d).otherwise(F.lit(0.0))


def rolling_mean(c: Column, n: int, w, min_periods: int | None = None) -> Column:
    """Mean of the last ``n`` rows, NULL until ``min_periods`` (default ``n``) of them are
    non-NULL — the pandas ``rolling(n, min_periods)`` rule.  [W4, W5]"""
    f = rows_frame(w, n)
    mp = n if min_periods is None else min_periods
    return F.when(F.count(c).over(f) >= mp, F.avg(c).over(f))


def rolling_std(c: Column, n: int, w, min_periods: int | None = None) -> Column:
    """Sample standard deviation of the last ``n`` rows with the same NULL rule."""
    f = rows_frame(w, n)
    mp = n if min_periods is None else min_periods
    return F.when(F.count(c).over(f) >= mp, F.stddev_samp(c).over(f))


def rsi_from_means(avg_gain: Column, avg_loss: Column) -> Column:
    """Simple-mean RSI: 100 - 100 / (1 + avg_gain / avg_loss); NULL when avg_loss is 0.  [W6]"""
    rs = avg_gain / F.nullif(avg_loss, F.lit(0.0))
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)


def with_exact_moving_sum(df: DataFrame, units: Column, n: int, w, out_sum: str, out_count: str) -> DataFrame:
    """Moving sum and count of the last ``n`` rows by prefix sums of integer units.

    ``sum`` over UNBOUNDED PRECEDING is evaluated incrementally by Spark (O(1) per row), and
    ``lag(n)`` is an offset frame, so the cost does not grow with ``n`` — unlike a ROWS frame,
    which Spark re-aggregates per row (O(n) per row).  Integer units keep the difference exact.
    Two window passes: running sums, then their lags.
    """
    cum_s, cum_c = f"_cum_s_{out_sum}", f"_cum_c_{out_sum}"
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select("*", F.sum(units).over(run).alias(cum_s), F.count(units).over(run).alias(cum_c))
    return df.select(
        *[c for c in df.columns if c not in (cum_s, cum_c)],
        (F.col(cum_s) - F.coalesce(F.lag(cum_s, n).over(w), F.lit(0))).alias(out_sum),
        (F.col(cum_c) - F.coalesce(F.lag(cum_c, n).over(w), F.lit(0))).alias(out_count),
    )


def indicator_lookback(ma_windows=K.MA_WINDOWS, rsi_period: int = K.RSI_PERIOD,
                       vol_window: int = K.VOLATILITY_WINDOW) -> int:
    """Rows of history the indicator set reads: MA(n) reads n rows back (prefix-sum lag), RSI
    reads ``rsi_period`` changes (one more close), volatility ``vol_window`` returns."""
    return max([*ma_windows, rsi_period + 1, vol_window + 1])


def add_indicators(bars: DataFrame, *, price_scale: int | None = None, ma_windows=K.MA_WINDOWS,
                   rsi_period: int = K.RSI_PERIOD, vol_window: int = K.VOLATILITY_WINDOW,
                   partition_cols=("symbol",), chunk_rows=None, order_col: str = "date",
                   chunk_bucket=None) -> DataFrame:
    """See :func:`_add_indicators`.  ``chunk_rows`` splits long series: with a number, every
    series is cut into pieces of that many rows plus a halo of the look-back (see
    :func:`tickweave.operators.series.series_chunks`), so no task holds a whole hot symbol.
    Results are identical either way, NULL symbols and dates included.  ``chunk_bucket``
    is the Column that numbers rows locally before the exact positions are summed (default:
    the calendar month of ``order_col``; use e.g. ``F.date_trunc("hour", "ts")`` for ticks)."""
    if not chunk_rows:
        return _add_indicators(bars, price_scale=price_scale, ma_windows=ma_windows, rsi_period=rsi_period,
                               vol_window=vol_window, partition_cols=partition_cols, order_col=order_col)
    from tickweave.operators.series import series_chunks
    if tuple(partition_cols) != ("symbol",):
        raise ValueError("chunking works on symbol series")
    halo = indicator_lookback(ma_windows, rsi_period, vol_window)
    ch = series_chunks(bars, halo, max(int(chunk_rows), halo), order_col=order_col, bucket=chunk_bucket)
    out = _add_indicators(ch, price_scale=price_scale, ma_windows=ma_windows, rsi_period=rsi_period,
                          vol_window=vol_window, partition_cols=("symbol", "_chunk"), order_col=order_col)
    return out.filter(~F.col("_halo")).drop("_chunk", "_halo", "series_idx", "series_len")


def _add_indicators(bars: DataFrame, *, price_scale: int | None = None, ma_windows=K.MA_WINDOWS,
                    rsi_period: int = K.RSI_PERIOD, vol_window: int = K.VOLATILITY_WINDOW,
                    partition_cols=("symbol",), order_col: str = "date") -> DataFrame:
    """Bars + change, daily_return, gain, loss, rsi, ma{n}, volatility.  [W1-W7]

    ``price_scale``: number of decimals the closes are exact to (2 for cents).  When given,
    moving averages use exact prefix sums of integer units — one running sum shared by every
    MA length, then ``lag(n)`` per length — so the cost does not grow with the window; without
    it they use ROWS frames.  Both give the pandas rolling-mean result.

    Plan: one Exchange + Sort on the series key, then two Window passes (the second reads the
    columns the first produced); every expression is built-in, so each pass is codegen'd.
    """
    w = series_window(partition_cols, order_col)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = [F.lag("close").over(w).alias("_prev")]
    if price_scale is not None and ma_windows:
        unit = float(10 ** price_scale)
        units = F.rint(F.col("close") * F.lit(unit)).cast("long")  # rint: no BigDecimal per row
        first += [F.sum(units).over(run).alias("_cs"), F.count(units).over(run).alias("_cc")]
    df = bars.select("*", *first)  # one select, so the three share one Window pass
    change = F.col("close") - F.col("_prev")
    # one projection (not a withColumn chain): the analyzer runs once
    df = df.select("*", change.alias("change"), pct_change(F.col("close"), F.col("_prev")).alias("daily_return"),
                   gain(change).alias("gain"), loss(change).alias("loss"))
    avg_gain = rolling_mean(F.col("gain"), rsi_period, w)
    avg_loss = rolling_mean(F.col("loss"), rsi_period, w)
    cols = [F.col(c) for c in df.columns if not c.startswith("_")]
    cols.append(rsi_from_means(avg_gain, avg_loss).alias("rsi"))
    for n in ma_windows:
        if price_scale is None:
            cols.append(rolling_mean(F.col("close"), n, w).alias(f"ma{n}"))
        else:
            msum = F.col("_cs") - F.coalesce(F.lag("_cs", n).over(w), F.lit(0))
            mcnt = F.col("_cc") - F.coalesce(F.lag("_cc", n).over(w), F.lit(0))
            cols.append(F.when(mcnt == n, msum.cast("double") / F.lit(float(n) * unit)).alias(f"ma{n}"))
    cols.append((rolling_std(F.col("daily_return"), vol_window, w) * F.lit(math.sqrt(K.TRADING_DAYS_PER_YEAR)))
                .alias("volatility"))
    return df.select(*cols)
