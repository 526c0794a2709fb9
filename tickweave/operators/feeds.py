"""News, alerts, flows and favourites: J2, L2, J4, A6, P8."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.indicators import series_window


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The first row of every ``key`` value by ``order_col`` (NULL keys form one group).

    An aggregate (``min_by`` of the whole row) rather than ``row_number`` over a window: the
    partial aggregation before the shuffle keeps one row per key and input split, so a key
    repeated in a third of all rows does not land whole in one task."""
    cols = [c for c in df.columns]
    first = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r"))
    return first.select("_r.*")


def unseen(news: DataFrame, seen: DataFrame, order_col: str = "feed_pos") -> DataFrame:
    """Articles whose url has not been seen; repeats inside the batch are removed (first one
    in feed order wins) and a missing url counts as one value.  [J2]

    The seen set is de-duplicated with a partial aggregate, then anti-joined with NULL-safe
    equality; AQE broadcasts it when it is small and otherwise splits skewed partitions."""
    firsts = first_per_key(news, "url", order_col)
    seen_urls = seen.select("url").distinct()
    return firsts.join(seen_urls, firsts["url"].eqNullSafe(seen_urls["url"]), "left_anti")


def rotating_pick(items: DataFrame, k: int, group_col: str, order_col: str = "feed_pos",
                  bucket_width: int | None = None, buckets_per_group: int = 4096) -> DataFrame:
    """Per group, the item at position ``k mod count`` in ``order_col`` order.  [L2]

    Exact k-th selection without sorting a whole group in one task: positions are cut into
    buckets, bucket counts (a partial aggregate) and their running sums locate the bucket
    holding the wanted position, and only that bucket is numbered.  By default each group's
    position range is cut into at most ``buckets_per_group`` buckets (from a per-group
    min/max aggregate), so the running-sum window is small even for sparse positions such as
    timestamps; ``bucket_width`` fixes the width instead."""
    if bucket_width is None:
        rng = items.groupBy(group_col).agg(F.min(order_col).alias("_lo"), F.max(order_col).alias("_hi"))
        width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(buckets_per_group)))
        rng = rng.withColumnRenamed(group_col, "_g")
        rows = items.join(rng, items[group_col].eqNullSafe(rng["_g"])).drop("_g").withColumn(
            "_b", F.floor((F.col(order_col) - F.col("_lo")) / width).cast("long")).drop("_lo", "_hi")
    else:
        rows = items.withColumn("_b", F.floor(F.col(order_col) / F.lit(bucket_width)).cast("long"))
    counts = rows.groupBy(group_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(group_col)
    cum = counts.withColumn("_cum", F.sum("_n").over(wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("_tot", F.sum("_n").over(wg))
    target = F.pmod(F.lit(k), F.col("_tot"))
    picked = cum.filter((F.col("_cum") - F.col("_n") <= target) & (target < F.col("_cum"))) \
        .select(F.col(group_col).alias("_g"), F.col("_b").alias("_gb"), (target - (F.col("_cum") - F.col("_n"))).alias("_off"), "_tot")
    inb = rows.join(picked, rows[group_col].eqNullSafe(picked["_g"]) & rows["_b"].eqNullSafe(picked["_gb"])).drop("_g", "_gb")
    w = Window.partitionBy(group_col, "_b").orderBy(order_col)
    return (
        inb.withColumn("_rn", F.row_number().over(w) - 1)
        .filter(F.col("_rn") == F.col("_off"))
        .withColumn("n_items", F.col("_tot"))
        .withColumn("pick_index", F.lit(k) % F.col("_tot"))
        .drop("_b", "_off", "_tot", "_rn")
    )


def article_card(news: DataFrame) -> DataFrame:
    """The fields the news card shows: publication time as text, the description or "No
    description.", the content or "Full content not available.", and the link when there is
    a url.  An empty text counts as missing, like NULL."""
    from tickweave import constants as K
    return news.withColumns({
        "published_text": F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"),
        "description_text": F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit(K.NO_DESCRIPTION)),
        "content_text": F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(K.NO_CONTENT)),
        "link": F.nullif(F.col("url"), F.lit("")),
    })


def fired_alerts(bars: DataFrame, alerts: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Bars where the close crosses a saved alert price: previous close < price <= close
    (``up``) or previous close > price >= close (``down``).  [J4]

    A range join done as an equi-join, so no symbol compares all its bars with all its
    alerts.  Prices are cut into buckets whose width is the symbol's mean absolute change;
    each bar is exploded into the buckets its [previous close, close] interval covers — about
    two per bar on average — each alert falls in one, and the join is on (symbol, bucket)
    followed by the exact predicate.

    ``chunk_rows`` splits long series into halo chunks (a one-row halo gives each piece the
    previous close it needs), and the bucket width becomes a per-symbol aggregate, so no task
    holds a whole hot symbol.  The result is the same."""
    moved = F.col("prev_close").isNotNull() & (F.col("prev_close") != F.col("close"))
    if chunk_rows:
        from tickweave.operators.series import series_chunks
        ch = series_chunks(bars.select("symbol", "date", "close"), 1, max(int(chunk_rows), 1))
        b = (ch.withColumn("prev_close", F.lag("close").over(series_window(("symbol", "_chunk"))))
             .filter(~F.col("_halo") & moved).select("symbol", "date", "close", "prev_close"))
        width = b.groupBy("symbol").agg(F.avg(F.abs(F.col("close") - F.col("prev_close"))).alias("_w"))
        b = b.join(width, "symbol")
    else:
        w = series_window()
        b = bars.select("symbol", "date", "close").withColumn("prev_close", F.lag("close").over(w))
        # bucket width: the symbol's mean absolute change, a window aggregate on the same partitioning
        b = b.withColumn("_w", F.avg(F.when(moved, F.abs(F.col("close") - F.col("prev_close"))))
                         .over(Window.partitionBy("symbol"))).filter(moved)
        width = b.groupBy("symbol").agg(F.max("_w").alias("_w"))
    return _crossed(b, width, alerts)


def crossings(moves: DataFrame, alerts: DataFrame) -> DataFrame:
    """``moves`` (symbol, prev_close, close and any others), price changes of any source, with the alerts
    that each one crosses and its ``direction``: the range join of :func:`fired_alerts`."""
    width = moves.groupBy("symbol").agg(F.avg(F.abs(F.col("close") - F.col("prev_close"))).alias("_w"))
    return _crossed(moves.join(width, "symbol"), width, alerts)


def _crossed(b: DataFrame, width: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows of ``b`` (with bucket width ``_w``) whose [prev_close, close] covers an alert price."""
    lo, hi = F.least("prev_close", "close"), F.greatest("prev_close", "close")
    bk = lambda x: F.floor(x / F.col("_w"))
    bb = b.withColumn("_bucket", F.explode(F.sequence(bk(lo), bk(hi)))).drop("_w")
    a = (alerts.select("alert_id", "symbol", F.col("price").alias("alert_price"))
         .join(width, "symbol").withColumn("_bucket", bk(F.col("alert_price"))).drop("_w"))
    j = bb.join(a, ["symbol", "_bucket"]).drop("_bucket")
    up = (F.col("prev_close") < F.col("alert_price")) & (F.col("alert_price") <= F.col("close"))
    down = (F.col("prev_close") > F.col("alert_price")) & (F.col("alert_price") >= F.col("close"))
    return j.filter(up | down).withColumn("direction", F.when(up, F.lit("up")).otherwise(F.lit("down")))


def net_flow(flows: DataFrame, keys=("date", "category")) -> DataFrame:
    """Buy, sell and net (= buy - sell) amount per key.  [A6]  One partial aggregate."""
    buy = F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(F.lit(0.0)))
    sell = F.sum(F.when(F.col("side") == "sell", F.col("amount")).otherwise(F.lit(0.0)))
    return flows.groupBy(*keys).agg(buy.alias("buy_value"), sell.alias("sell_value")) \
        .withColumn("net_value", F.col("buy_value") - F.col("sell_value"))


def favorites_distinct(favs: DataFrame) -> DataFrame:
    """Each (user, symbol) once, at the time it was first added; ``position`` numbers a user's
    list in first-added order.  [P8]  The aggregate collapses repeats before the per-user
    numbering, so the window sorts at most one row per symbol per user."""
    from tickweave.sources.bars import ts_seq_key
    # (time, event id) as one fixed-width key keeps the aggregate hash-based
    firsts = favs.groupBy("user_id", "symbol").agg(
        F.min(ts_seq_key(F.col("added_at"), F.col("event_id"))).alias("_first"),
        F.min("added_at").alias("first_added"), F.count(F.lit(1)).alias("n_adds"))
    w = Window.partitionBy("user_id").orderBy(F.col("_first"))
    return firsts.withColumn("position", F.row_number().over(w).cast("long")).drop("_first")


def favorites_list(favs: DataFrame) -> DataFrame:
    """A user's favourites as one ordered array (insertion order, no repeats)."""
    d = favorites_distinct(favs)
    return d.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"]).alias("favorites"))
