"""Per-symbol series operators: last values, trailing statistics, tails, quotes,
look-back samples and the chronological split."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave import constants as K
from tickweave.functions.indicators import series_window


def latest(df: DataFrame, cols: Iterable[str], key: str = "symbol", order_col: str = "date") -> DataFrame:
    """Value of each column on the last row of every symbol.  [A2]

    It is the last *row*: a NULL there gives NULL (``max_by`` keeps it), not the last
    non-NULL value.  One hash aggregate with a partial phase, so only one row per symbol and
    input split is shuffled."""
    return df.groupBy(key).agg(
        F.max(order_col).alias(f"last_{order_col}"),
        *[F.max_by(c, order_col).alias(f"last_{c}") for c in cols],
    )


def trailing_stats(bars: DataFrame, vol_rows: int = K.AVG_VOLUME_WINDOW, hl_rows: int = K.WEEKS52_ROWS) -> DataFrame:
    """Latest close, mean volume of the last ``vol_rows`` rows, high/low of the last
    ``hl_rows`` rows — or of all rows when a symbol has fewer.  [A3]

    ``row_number() <= max(vol_rows, hl_rows)`` becomes a ``WindowGroupLimit`` with a partial
    phase before the shuffle, so at most that many rows per symbol and input split are
    exchanged — a hot symbol costs no more than any other — and the aggregate shares the
    ``symbol`` partitioning of the window."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    rn = F.col("_rn")
    keep = max(vol_rows, hl_rows)
    return (
        bars.withColumn("_rn", F.row_number().over(w))
        .filter(rn <= keep)
        .groupBy("symbol")
        .agg(
            F.max("date").alias("last_date"),
            F.max_by("close", "date").alias("last_close"),
            F.avg(F.when(rn <= vol_rows, F.col("volume"))).alias("avg_volume_20"),
            F.max(F.when(rn <= hl_rows, F.col("high"))).alias("high_52w"),
            F.min(F.when(rn <= hl_rows, F.col("low"))).alias("low_52w"),
        )
    )


def tail(df: DataFrame, n: int, key: str = "symbol", order_col: str = "date") -> DataFrame:
    """Last ``n`` rows of each symbol.  [L1]

    ``row_number() <= n`` over a descending window is rewritten by Catalyst into a
    ``WindowGroupLimit`` that keeps only ``n`` rows per symbol before and after the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_indicators(bars: DataFrame, n: int, **options) -> DataFrame:
    """The last ``n`` rows of each symbol with their indicators (``options`` as of ``add_indicators``), from the
    ``n`` rows and the look-back before them only.  [A2, L1, P1]

    The cut is a ``WindowGroupLimit`` before the shuffle, so a symbol's older history is neither exchanged
    nor put through the indicator windows."""
    from tickweave.functions.indicators import add_indicators, indicator_lookback
    known = {k: options[k] for k in ("ma_windows", "rsi_period", "vol_window") if k in options}
    return tail(add_indicators(tail(bars, n + indicator_lookback(**known)), **options), n)


def series_min_max(bars: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, s_min, s_max) of every series.  [A5]  A hash aggregate with a partial phase: one row per
    symbol and input split is exchanged."""
    return bars.groupBy("symbol").agg(F.min(value).alias("s_min"), F.max(value).alias("s_max"))


def select_columns(df: DataFrame, cols: Iterable[str], keys=("symbol", "date")) -> DataFrame:
    """Projection of the key columns and the wanted ones.  [P1]"""
    return df.select(*keys, *cols)


def add_if_missing(df: DataFrame, name: str, make: Callable[[DataFrame], Column]) -> DataFrame:
    """Add column ``name`` only when the frame does not have it yet.  [P4]

    Decided on the schema, so no job runs; ``make`` receives the frame and returns a Column."""
    if name in df.columns:
        return df
    return df.withColumn(name, make(df))


def index_quote(bars: DataFrame) -> DataFrame:
    """Latest price, change and change % against the previous bar of each symbol.  [F9]

    The provider of the reference supplies these three numbers; here they come from bars.
    Only the last two bars of a symbol matter: a top-2 ``WindowGroupLimit``, then an
    aggregate.  A symbol with one bar has NULL change ("data unavailable")."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last2 = (
        bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
        .groupBy("symbol")
        .agg(F.max("date").alias("quote_date"),
             F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("price"),
             F.max(F.when(F.col("_rn") == 2, F.col("close"))).alias("prev_close"))
    )
    return last2.select(
        "symbol", "quote_date", "price",
        (F.col("price") - F.col("prev_close")).alias("change"),
        (F.try_divide(F.col("price") - F.col("prev_close"), F.col("prev_close")) * F.lit(100.0)).alias("change_pct"),
    )


def lag_windows(df: DataFrame, value: str, look_back: int = K.DEFAULT_LOOK_BACK,
                partition_cols=("symbol",)) -> DataFrame:
    """Look-back samples: features = the ``look_back`` previous values, label = the current
    one; only rows with a full window are kept, so a series of ``n`` rows gives ``n - L``
    samples.  [W8]"""
    lo, hi = K.LOOK_BACK_RANGE
    if not lo <= look_back <= hi:
        raise ValueError(f"look_back must be in {lo}..{hi}")
    w = series_window(partition_cols)
    feats = F.collect_list(F.col(value)).over(w.rowsBetween(-look_back, -1))
    return (
        df.withColumn("features", feats)
        .withColumn("label", F.col(value))
        .filter(F.size("features") == look_back)
    )


def chronological_split(samples: DataFrame, train_fraction: float = K.TRAIN_FRACTION,
                        partition_cols=("symbol",), order_col: str = "date") -> DataFrame:
    """``is_train`` = the first ``int(n_samples * fraction)`` samples of each series.  [W9]

    Computed after the look-back filter, as the reference splits the sample arrays."""
    w = series_window(partition_cols, order_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition_cols))
    k = F.floor(n * F.lit(train_fraction))
    return samples.withColumn("sample_idx", F.row_number().over(w) - 1).withColumn(
        "is_train", F.col("sample_idx") < k
    )


# ---------------------------------------------------------------------------------------------
# Splitting long (hot) series: exact positions and halo chunks
# ---------------------------------------------------------------------------------------------

def series_index(df: DataFrame, key: str = "symbol", order_col: str = "date", bucket=None) -> DataFrame:
    """Adds ``series_idx`` (0-based position in the series by ``order_col``) and ``series_len``
    without sorting any whole series in one task.

    Rows are numbered inside (key, bucket) — by default the calendar month of ``order_col`` —
    bucket sizes are counted, and running sums over the small (key, bucket) count table give
    each bucket its offset.  A symbol holding a third of all rows is spread over as many tasks
    as it has buckets.  ``order_col`` must be unique inside a series."""
    b = bucket if bucket is not None else F.trunc(F.col(order_col), "month")
    # the window and the join share one plain key, so the rows are exchanged once: a struct's NULL fields
    # are equal to one another, NULL keys and NULL order values are rows like any other
    wb = Window.partitionBy("_bk")
    # one window pass gives the position inside the bucket and the bucket size; the counts
    # branch below reads the same pass, so the input is exchanged once
    d = df.withColumn("_bk", F.struct(F.col(key).alias("k"), b.alias("b"))).select(
        "*", (F.row_number().over(wb.orderBy(order_col)) - 1).alias("_rn"), F.count(F.lit(1)).over(wb).alias("_bn"))
    counts = d.filter(F.col("_rn") == 0).select("_bk", "_bn")
    wk = Window.partitionBy("_bk.k")
    offs = counts.select(
        F.col("_bk").alias("_obk"),
        F.coalesce(F.sum("_bn").over(wk.orderBy("_bk.b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(wk).alias("series_len"),
    )
    return (d.join(offs, d["_bk"] == offs["_obk"])
            .withColumn("series_idx", (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_obk", "_bk", "_rn", "_bn", "_off"))


def series_chunks(df: DataFrame, halo: int, rows_per_chunk: int, key: str = "symbol",
                  order_col: str = "date", bucket=None) -> DataFrame:
    """Cuts every series into pieces of ``rows_per_chunk`` rows (column ``_chunk``); the last
    ``halo`` rows of a piece are also copied into the next piece with ``_halo = true``.

    A window partitioned by (key, ``_chunk``) that looks back at most ``halo`` rows then gives
    every non-halo row exactly the value it has over the whole series; halo rows are dropped
    afterwards.  Each row is copied at most once, so the extra volume is halo/rows_per_chunk."""
    if rows_per_chunk < halo:
        raise ValueError("rows_per_chunk must be at least the halo")
    ix = series_index(df, key, order_col, bucket)
    c = F.floor(F.col("series_idx") / F.lit(rows_per_chunk))
    pos = F.col("series_idx") - c * F.lit(rows_per_chunk)
    has_next = (c + 1) * F.lit(rows_per_chunk) < F.col("series_len")
    home = F.struct(c.alias("_chunk"), F.lit(False).alias("_halo"))
    nxt = F.struct((c + 1).alias("_chunk"), F.lit(True).alias("_halo"))
    targets = F.when((pos >= F.lit(rows_per_chunk - halo)) & has_next, F.array(home, nxt)).otherwise(F.array(home))
    return ix.withColumn("_t", F.explode(targets)).select("*", "_t._chunk", "_t._halo").drop("_t")
