"""Bars: building OHLCV bars from trades (S3), loading a date range (S1), the recent slice (S2)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.sources.tables import read_table

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]


def packed_key(parts: list[tuple[Column, int]]) -> Column:
    """An ordering key packed into one ``decimal(38,0)``: each part is a non-negative integral
    column (int/long) with at most the given number of digits, most significant part first,
    so the packed number sorts exactly like the tuple.  A part outside its range fails the job
    (``raise_error``) instead of silently mis-ordering.

    Why: ``min_by``/``max_by`` with a struct key have a variable-width buffer, which forces
    Spark onto a sort-based aggregate (a full sort of every raw trade before and after the
    shuffle); a decimal key keeps the hash aggregate with its map-side combine.  Consecutive
    parts are combined in ``long`` arithmetic while they fit in 18 digits, so only a couple of
    decimal operations run per row."""
    total = sum(d for _, d in parts)
    if total > 38:
        raise ValueError("packed key needs more than 38 digits")
    ok = None
    groups: list[tuple[Column, int]] = []  # (long column, digits)
    for c, digits in parts:
        in_range = c.isNotNull() & (c >= 0) & (c < F.lit(10 ** digits))
        ok = in_range if ok is None else (ok & in_range)
        c = c.cast("long")
        if groups and groups[-1][1] + digits <= 18:
            g, gd = groups[-1]
            groups[-1] = (g * F.lit(10 ** digits) + c, gd + digits)
        else:
            groups.append((c, digits))
    key = None
    for g, gd in groups:
        v = g.cast("decimal(38,0)")
        key = v if key is None else key * F.lit(10 ** gd).cast("decimal(38,0)") + v
    return F.when(ok, key).otherwise(F.raise_error(F.lit("packed_key: part out of range")).cast("decimal(38,0)"))


def build_bars(trades: DataFrame, *, symbol: str = "symbol", ts: str = "ts", price: str = "price",
               qty: str = "qty", seq: list[str] | None = None, every: str | None = None,
               order_key: Column | None = None) -> DataFrame:
    """Raw trades -> OHLCV bars, one row per (symbol, bucket).  [S3]

    ``every=None`` gives daily bars keyed by ``date``; otherwise a tumbling ``window`` of that
    length keyed by its start timestamp ``bar_start``.  Open and close are the first and last
    trade by ``(ts, *seq)``: the ordering key must be unique inside a bucket, or first/last
    become arbitrary, so callers name tie-break columns in ``seq``.

    Plan with ``order_key`` (a fixed-width key that orders trades the same way inside a bucket, see
    :func:`packed_key`): one hash aggregate with a partial (map-side) phase before the shuffle, so a
    symbol holding a third of all trades is reduced to one row per bucket per input split before it
    is exchanged; the shuffle is on (symbol, bucket), which spreads a hot symbol over many reducers.

    Plan without: the same hash aggregate on the time alone, then the first and last trades alone, see
    :func:`timed_bars`. Any ``seq`` columns serve, of any type and size.
    """
    if every is None:
        bucket = F.to_date(F.col(ts)).alias("date")
        key = "date"
    else:
        bucket = F.window(F.col(ts), every).start.alias("bar_start")
        key = "bar_start"
    rows = trades.select(F.col(symbol).alias("symbol"), bucket, F.col(price).alias("price"), F.col(qty).alias("qty"),
                         *([F.struct(*[F.col(c) for c in seq]).alias("_seq")] if seq and order_key is None else []),
                         (time_units(F.col(ts), dict(trades.dtypes)[ts]) if order_key is None else order_key).alias("_ord"))
    if order_key is None:
        return timed_bars(rows, key)
    return rows.groupBy("symbol", key).agg(
        F.min_by("price", "_ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_ord").alias("close"),
        F.sum("qty").alias("volume"),
    )


def time_units(ts: Column, kind: str) -> Column:
    """A time as a long that orders the same way: microseconds since 1970 (a date's midnight, a zoneless
    timestamp's own clock); a missing time comes before all others."""
    if kind in ("date", "timestamp_ntz"):  # by the calendar: a session zone's clock changes play no part
        units = F.unix_date(F.to_date(ts)).cast("long") * F.lit(86_400_000_000)
        if kind == "timestamp_ntz":
            units = (units + F.hour(ts) * F.lit(3_600_000_000).cast("long") + F.minute(ts) * F.lit(60_000_000).cast("long")
                     + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("long"))
    else:
        units = F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(units, F.lit(-(10 ** 17)).cast("long"))


#: Bars of several trades that may be broadcast (two small rows each, some 20 MB in all); more are joined by a shuffle.
BROADCAST_TIES = 200_000


def timed_bars(rows: DataFrame, key: str) -> DataFrame:
    """Bars of (symbol, ``key``, price, qty, _ord: the time as a long, _seq: tie-break struct or none).

    First pass: one hash aggregate of plain numbers - the first and last time, a price at each, high, low,
    volume and the count - written to the shared folder, as both passes read it. Bars of one trade are whole.

    Second pass, only where two trades share a first or last time: the trades at these times of bars of
    several meet them on (symbol, bucket, time) and are compared by ``_seq``. A hot symbol is many such
    keys; bars of one trade are not exchanged again. Where every bar of several trades spans some time,
    its trades at both ends are counted first."""
    from tickweave.session import materialize_table
    if "_seq" not in rows.columns:  # nothing to tell ties apart: first and last are arbitrary among them
        return rows.groupBy("symbol", key).agg(
            F.min_by("price", "_ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "_ord").alias("close"), F.sum("qty").alias("volume"))
    bars = materialize_table(rows.groupBy("symbol", key).agg(
        F.min_by("price", "_ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_ord").alias("close"), F.sum("qty").alias("volume"),
        F.min("_ord").alias("_first"), F.max("_ord").alias("_last"), F.count(F.lit(1)).alias("_n")), "bars")
    out = ["symbol", key, "open", "high", "low", "close", "volume"]
    several = bars.filter("_n > 1")
    many, sure = several.agg(F.count(F.lit(1)), F.count_if(F.col("_first") == F.col("_last"))).first()
    if not many:
        return bars.select(*out)
    end = lambda t, opens, closes: F.struct(F.col(t).alias("t"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
    ends = F.when(F.col("_first") == F.col("_last"), F.array(end("_first", True, True))) \
        .otherwise(F.array(end("_first", True, False), end("_last", False, True)))
    ties = several.select(F.col("symbol").alias("_s"), F.col(key).alias("_k"), F.explode(ends).alias("_e"))
    if many <= BROADCAST_TIES:
        ties = F.broadcast(ties)
    at_end = rows["symbol"].eqNullSafe(ties["_s"]) & rows[key].eqNullSafe(ties["_k"]) & (rows["_ord"] == ties["_e.t"])
    tied = rows.drop("qty").join(ties, at_end)
    if not sure and tied.groupBy("_s", "_k", "_e.t").count().filter("count > 1").isEmpty():
        return bars.select(*out)
    settled = tied.groupBy("_s", "_k").agg(  # over trades at a first or last time only
        F.min_by("price", F.when(F.col("_e.opens"), F.col("_seq"))).alias("open"),
        F.max_by("price", F.when(F.col("_e.closes"), F.col("_seq"))).alias("close"))
    both = several.drop("open", "close").join(settled, several["symbol"].eqNullSafe(settled["_s"]) & several[key].eqNullSafe(settled["_k"]), "left")
    return bars.filter("_n = 1").select(*out).unionByName(both.select(*out))


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``lineitem`` read as a trade tape: supplier = symbol, ship date = time,
    extended price = price, quantity = size.  ``(l_orderkey, l_linenumber)`` is not unique, so
    the tie-break key carries part key, price and quantity as well."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     "l_quantity", "l_shipdate"])
    return trades_from(li)


def trades_from(li: DataFrame) -> DataFrame:
    """``lineitem`` rows (batch or stream) as trades; ``ts`` is a zoned timestamp."""
    return li.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


LINEITEM_SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "price", "qty"]


def ts_seq_key(ts: Column, seq: Column) -> Column:
    """``(timestamp, sequence number)`` packed into one decimal for ``min_by``/``max_by``/``min``:
    microseconds since 1970 shifted by 10^16 (so dates back to 1653 stay positive, 17 digits),
    then the sequence number (up to 18 digits)."""
    return packed_key([(F.unix_micros(ts.cast("timestamp")) + F.lit(10 ** 16), 17), (seq, 18)])


def exact_units(c: Column, scale: int) -> Column:
    """``c * 10^scale`` as a long when that is an integer (to 1e-6), else -1 (which no packed
    key accepts).  ``rint`` rather than ``round``: Spark rounds doubles through BigDecimal."""
    x = c * F.lit(float(10 ** scale))
    u = F.rint(x)
    return F.when(F.abs(x - u) < F.lit(1e-6), u.cast("long")).otherwise(F.lit(-1).cast("long"))


def daily_bars(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Daily bars of every supplier built from ``lineitem`` (the ``bars`` fixture).  The
    aggregate runs on the numeric supplier key (cheaper to hash and shuffle); the key becomes
    the string symbol on the aggregated rows only.  ``start``/``end`` (half-open, dates) are
    compared with the raw ship-date column, so they reach the parquet scan as pushed filters
    instead of filtering derived dates after the read."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     "l_quantity", "l_shipdate"])
    if start is not None:
        li = li.filter(F.col("l_shipdate") >= _as_date(start).cast("timestamp_ntz"))
    if end is not None:
        li = li.filter(F.col("l_shipdate") < _as_date(end).cast("timestamp_ntz"))
    # the key's parts are projected first, so the packed key's range checks refer to plain
    # columns instead of repeating the unit conversions (a much smaller expression tree)
    trades = li.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
                       F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
                       "l_orderkey", "l_linenumber", "l_partkey",
                       exact_units(F.col("l_extendedprice"), 2).alias("_cents"),
                       exact_units(F.col("l_quantity"), 0).alias("_units"))
    key = packed_key([(F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 11),
                      (F.col("_cents"), 10), (F.col("_units"), 3)])
    bars = build_bars(trades, order_key=key)
    return bars.withColumn("symbol", F.col("symbol").cast("string"))


def _as_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.to_date(F.lit(d))


def load_bars(bars: DataFrame, start, end) -> DataFrame:
    """Bars with ``start <= date < end`` (half-open).  [S1]

    Written as a plain filter so Catalyst pushes it into the parquet scan when ``bars`` is
    a stored table (``PushedFilters`` in the plan)."""
    return bars.filter((F.col("date") >= _as_date(start)) & (F.col("date") < _as_date(end)))


def recent_bars(bars: DataFrame, as_of, months: int = 1) -> DataFrame:
    """The last ``months`` of bars up to and including ``as_of``.  [S2]

    The reference asks its provider for "one month up to now"; here the clock is explicit."""
    a = _as_date(as_of)
    return bars.filter((F.col("date") > F.add_months(a, -months)) & (F.col("date") <= a))


def smooth_bars(bars: DataFrame, n: int = 60, price_scale: int = 2) -> DataFrame:
    """Bars whose close is the mean of the last ``n`` closes; the first ``n-1`` rows of each
    symbol are dropped (the ``bars_smooth`` fixture, used to reach every trade-rule branch).

    The window sum runs on integer price units (``price_scale`` decimals), so it is exact and
    independent of the summation order; the mean is one division at the end."""
    from tickweave.functions.indicators import series_window, with_exact_moving_sum

    w = series_window()
    units = F.rint(F.col("close") * F.lit(float(10 ** price_scale))).cast("long")
    return (
        with_exact_moving_sum(bars, units, n, w, "_s", "_c")
        .filter(F.col("_c") == n)
        .withColumn("close", F.col("_s").cast("double") / F.lit(float(n * 10 ** price_scale)))
        .drop("_s", "_c")
    )


def store_bars(bars: DataFrame, name: str | None = None, buckets: int | None = None,
               path: str | None = None) -> str:
    """Write bars as a table bucketed (and sorted) by symbol; returns the table name.

    Every later per-symbol window, aggregate or join on ``symbol`` reads co-located data and
    needs no Exchange.  The rows are hash-partitioned with the bucketing function first, so
    each bucket is one file.  The table lives at ``path`` (default: a fresh folder under the
    shared ``spark.checkpoint.dir``), never in a machine-local warehouse."""
    import uuid

    from tickweave.session import shared_dir
    spark = bars.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or shared_dir(spark, "bars-table")
    name = name or f"bars_{uuid.uuid4().hex[:12]}"
    (bars.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol", "date")
     .option("path", path).mode("overwrite").saveAsTable(name))
    return name


def read_bars(spark: SparkSession, name: str) -> DataFrame:
    """A bucketed bar table written by :func:`store_bars`."""
    return spark.table(name)
