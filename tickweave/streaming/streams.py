"""Structured Streaming forms of the live views (T1-T6).

The reference re-runs its whole script on a timer (30 s market view, 50 s stock view, 300 s
flows).  Here each live view is a streaming query: sources are file streams over parquet,
state lives in Spark's state store under a checkpoint in the shared ``spark.checkpoint.dir``
tree, and sinks are files or idempotent ``foreachBatch`` writers — so a restarted query (or a
lost executor) resumes from its checkpoint without duplicating output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave import constants as K
from tickweave.session import freed_shuffles, shared_dir
from tickweave.streaming.versions import VersionedTable

# T1: refresh cadences of the reference's three live views, as processing-time triggers.
CADENCE = {
    "market": f"{K.MARKET_REFRESH_SECONDS} seconds",
    "stock": f"{K.STOCK_REFRESH_SECONDS} seconds",
    "flows": f"{K.FLOW_REFRESH_SECONDS} seconds",
}


def trigger_for(view: str | None) -> dict:
    """``trigger`` keyword arguments: the view's cadence, or ``availableNow`` (process what is
    there, then stop) when ``view`` is None — the form used by tests and batch back-fills.  [T1]"""
    if view is None:
        return {"availableNow": True}
    return {"processingTime": CADENCE[view]}


def parquet_stream(spark: SparkSession, path: str, schema=None, glob: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """A file stream over a parquet folder; ``glob`` picks one table out of a shared folder."""
    if schema is None:
        schema = spark.read.parquet(f"{path}/{glob}" if glob else path).schema
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table as a file stream: a folder of part files, or the single file beside other tables."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if _is_folder(spark, path):
        return parquet_stream(spark, path, max_files=max_files)
    return parquet_stream(spark, sf_dir, glob=f"{name}.parquet", max_files=max_files)


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _is_folder(spark: SparkSession, folder: str) -> bool:
    path, fs = _hadoop_path(spark, folder)
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def _earlier_batches(spark: SparkSession, out: str, batch_id: int, columns: list[str]) -> DataFrame | None:
    """What batches before ``batch_id`` wrote to ``out``; None before the first one.  Any failure to
    read an existing folder fails the batch: taking it for "nothing yet" would emit everything again."""
    if not _is_folder(spark, out):
        return None
    return spark.read.parquet(out).filter(F.col("batch_id") < batch_id).select(*columns)


# --- T2: news, each url once ---------------------------------------------------------------------

def stream_unseen_news(news: DataFrame, seen: DataFrame, watermark: str | None = None) -> DataFrame:
    """Emit each article url once, skipping urls already seen.  [T2]

    With ``watermark`` the de-duplication state of a url is dropped once the watermark passes
    its publication time plus the delay (bounded state; a repeat arriving later than that is
    emitted again): a bounded form to choose.  The default ``watermark=None`` keeps every url forever — the exact "seen set" of the
    reference, with state that grows with the number of distinct urls.  Between repeats inside
    one micro-batch the engine keeps one, not necessarily the first in feed order."""
    if watermark:
        d = news.withWatermark("published_at", watermark).dropDuplicatesWithinWatermark(["url"])
    else:
        d = news.dropDuplicates(["url"])
    s = seen.select("url").distinct()
    return d.join(s, d["url"].eqNullSafe(s["url"]), "left_anti")


def unseen_batch_writer(seen: DataFrame, out: str, order_col: str = "feed_pos"):
    """The exact form of T2 as a ``foreachBatch`` function: inside a micro-batch the first
    repeat in feed order wins (the batch operator J2), and urls already seen or emitted by an
    earlier batch are anti-joined away with NULL-safe equality.  [T2]

    Its history is every url emitted so far — the reference's "seen forever" set, which grows
    with the number of distinct urls.  Output goes to ``out/batch_id=<id>`` with overwrite and
    only earlier batches are read, so a replayed batch gives the same rows."""
    from tickweave.operators.feeds import unseen

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = unseen(batch, seen)
        done = _earlier_batches(spark, out, batch_id, ["url"])
        if done is not None:
            fresh = fresh.join(done, fresh["url"].eqNullSafe(done["url"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


# --- T3: newest price per symbol --------------------------------------------------------------

def stream_latest_quote(quotes: DataFrame, seq: str | None = None) -> DataFrame:
    """Newest price per symbol (by tick time, then ``seq``), kept current.  [T3]  One aggregate
    whose state is one row per symbol."""
    from tickweave.sources.bars import ts_seq_key
    order = ts_seq_key(F.col("ts"), F.col(seq)) if seq else F.col("ts")
    return quotes.groupBy("symbol").agg(
        F.max("ts").alias("last_ts"), F.max_by("price", order).alias("price"), F.count(F.lit(1)).alias("n_ticks"))


# --- T4: tumbling OHLCV bars ------------------------------------------------------------------

def stream_bars(ticks: DataFrame, every: str = "1 hour", watermark: str = "2 hours",
                seq: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars from ticks, emitted once a bar can no longer change (append
    mode: the watermark has passed the bar's end).  [T4]  Streaming form of ``build_bars``;
    ``volume`` counts ticks when there is no size column."""
    if seq:
        from tickweave.sources.bars import ts_seq_key
        order_key = ts_seq_key(F.col("ts"), F.col(seq))  # fixed width: hash aggregate, small state rows
    else:
        order_key = F.col("ts")
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy(F.window("ts", every).alias("bar"), "symbol")
        .agg(F.min_by("price", order_key).alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", order_key).alias("close"),
             F.count(F.lit(1)).alias("ticks"))
        .select("symbol", F.col("bar.start").alias("bar_start"), F.col("bar.end").alias("bar_end"),
                "open", "high", "low", "close", "ticks")
    )


# --- T5: indicators kept current --------------------------------------------------------------

def _latest_version(spark: SparkSession, folder: str, below: int) -> int | None:
    """Highest ``v=<n>`` sub-folder with n < ``below`` (a directory listing on the driver)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    best = None
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            n = int(name[2:])
            if n < below and (best is None or n > best):
                best = n
    return best


def indicator_batch_writer(tail_dir: str, out: str, history_rows: int = K.WEEKS52_ROWS,
                           price_scale: int | None = None, rejected: str | None = None):
    """A ``foreachBatch`` function that keeps indicators current as new bars arrive.  [T5]

    Row windows are not allowed on streams, so each micro-batch (a static DataFrame) is run
    through the *batch* indicator code together with the **tail**: the last ``history_rows``
    bars of every symbol, kept as a versioned table ``tail_dir/v=<batch_id>``.  Per batch the
    work is bounded by (#symbols x history_rows + new bars), however long the history grows.

    Idempotent: outputs go to ``out/batch_id=<id>`` and the tail to ``v=<id>`` with overwrite,
    and a batch reads the newest tail *before* its own id, so a replayed batch rewrites the
    same folders.  Readers take the newest batch per (symbol, date) (:func:`current_indicators`).

    Late bars: a bar is placed exactly when at least the indicators' look-back of tail rows
    precede it (or the symbol's whole history is still in the tail); rows after it are then
    recomputed and re-emitted.  An older bar is written to ``rejected`` (default: ``out`` with
    ``_rejected`` appended), never dropped.  Of two versions of a bar in one batch one stays."""
    from tickweave.functions.indicators import add_indicators, indicator_lookback
    from tickweave.sources.bars import BAR_COLUMNS

    lookback = indicator_lookback()
    if history_rows <= lookback:
        raise ValueError("history_rows must exceed the indicators' look-back")

    rejected = rejected or f"{out.rstrip('/')}_rejected"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*BAR_COLUMNS).dropDuplicates(["symbol", "date"])
        prev = _latest_version(spark, tail_dir, batch_id)
        if prev is None:
            accepted, frame = new, new
        else:
            tail = spark.read.parquet(f"{tail_dir}/v={prev}").select(*BAR_COLUMNS)
            wa = Window.partitionBy("symbol").orderBy("date")
            # per symbol: is the tail full, and the date of its lookback-th oldest row
            cut = (tail.withColumn("_rn", F.row_number().over(wa))
                   .groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"),
                                          F.max(F.when(F.col("_rn") == lookback, F.col("date"))).alias("_cut")))
            j = new.join(cut, "symbol", "left")
            ok = F.col("_n").isNull() | (F.col("_n") < history_rows) | (F.col("date") > F.col("_cut"))
            accepted = j.filter(ok).select(*BAR_COLUMNS)
            if not j.filter(~ok).isEmpty():
                j.filter(~ok).select(*BAR_COLUMNS).write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
            frame = tail.join(accepted.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(accepted)
        touched = accepted.groupBy("symbol").agg(F.min("date").alias("_from"))
        ind = add_indicators(frame, price_scale=price_scale)
        res = ind.join(touched, "symbol").filter(F.col("date") >= F.col("_from")).drop("_from")
        res.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        wd = Window.partitionBy("symbol").orderBy(F.col("date").desc())
        (frame.withColumn("_rn", F.row_number().over(wd)).filter(F.col("_rn") <= history_rows).drop("_rn")
         .write.mode("overwrite").parquet(f"{tail_dir}/v={batch_id}"))

    return write


def current_indicators(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every (symbol, date) written by :func:`indicator_batch_writer`."""
    df = spark.read.parquet(out)
    w = Window.partitionBy("symbol", "date").orderBy(F.col("batch_id").desc())
    return df.withColumn("_v", F.row_number().over(w)).filter("_v = 1").drop("_v", "batch_id")


# --- flows view (300 s cadence) -----------------------------------------------------------------

def stream_net_flow(flows: DataFrame, keys=("category",)) -> DataFrame:
    """Buy / sell / net per category kept current from a stream of flow rows (the view the
    reference refreshes every 300 s).  A streaming aggregate: its state is one row per key,
    written in complete mode."""
    from tickweave.operators.feeds import net_flow
    return net_flow(flows, keys)


# --- T6: alerts fired by live trades ------------------------------------------------------------

def alert_batch_writer(alerts: DataFrame, out: str):
    """A ``foreachBatch`` function that fires each saved alert once, when a trade reaches its
    price (price >= alert price).  [T6]

    Only the batch's highest price per symbol matters, so trades are first reduced to one row
    per symbol (a partial aggregate: a hot symbol is combined map-side); that row meets the
    symbol's alerts, so no trade is ever paired with an alert.  Alerts fired by earlier batches
    are anti-joined away — that history is bounded by the alerts table.  Written to
    ``out/batch_id=<id>`` with overwrite and reading only earlier batches, so a replayed batch
    gives the same rows."""
    a = alerts.select("alert_id", "symbol", F.col("price").alias("alert_price"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = batch.groupBy("symbol").agg(F.max("price").alias("_top"))
        hit = a.join(top, "symbol").filter(F.col("_top") >= F.col("alert_price")).drop("_top")
        done = _earlier_batches(spark, out, batch_id, ["alert_id"])
        if done is not None:
            hit = hit.join(done, "alert_id", "left_anti")
        hit.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def fired_alerts_table(spark: SparkSession, out: str) -> DataFrame:
    """All alerts fired so far (each once)."""
    return spark.read.parquet(out).drop("batch_id")


# --- running helpers ----------------------------------------------------------------------------

def run_to_versions(df: DataFrame, name: str, mode: str = "complete", view: str | None = None, checkpoint: str | None = None,
                    out: str | None = None) -> tuple[StreamingQuery, VersionedTable]:
    """Start ``df`` into a table that every micro-batch replaces as a whole: readers take ``table.read()`` and
    never meet half a refresh, nor none.  [T1, T3]  With ``view=None`` wait until the input is processed."""
    spark = df.sparkSession
    table = VersionedTable(spark, out or shared_dir(spark, f"{name}-out"))
    q = (df.writeStream.queryName(f"{name}_{abs(hash(table.path)) % 10**8}").outputMode(mode)
         .option("checkpointLocation", checkpoint or shared_dir(spark, f"{name}-ckpt")).trigger(**trigger_for(view))
         .foreachBatch(lambda batch, batch_id: table.write(batch, batch_id)).start())
    if view is None:
        q.awaitTermination()
    return q, table


def replay(rows: DataFrame, slice_of: Column, slices: int, name: str, write) -> None:
    """Run a table through a stream into the ``foreachBatch`` function ``write``: its slices (numbers from 0
    on) arrive one after the other, each in as many files as it has, and each is one micro-batch of one
    query that stops and resumes from its checkpoint."""
    spark = rows.sparkSession
    held, src, checkpoint = (shared_dir(spark, f"{name}-{x}") for x in ("slices", "in", "ckpt"))
    with freed_shuffles(spark):
        rows.withColumn("_slice", slice_of.cast("int")).write.partitionBy("_slice").parquet(held)
    folder, fs = _hadoop_path(spark, src)
    fs.mkdirs(folder)
    for k in range(slices):
        if not _arrive(spark, f"{held}/_slice={k}", src, f"{k:06d}-"):
            rows.limit(0).write.mode("append").parquet(src)  # an empty slice is a micro-batch too
        parquet_stream(spark, src, schema=rows.schema).writeStream.option("checkpointLocation", checkpoint) \
            .foreachBatch(write).trigger(**trigger_for(None)).start().awaitTermination()


def _arrive(spark: SparkSession, slice_dir: str, src: str, prefix: str) -> int:
    """Move a slice's files into the stream's folder, so that no row is stored twice; their number."""
    at, fs = _hadoop_path(spark, slice_dir)
    if not fs.exists(at):
        return 0
    files = [st.getPath() for st in fs.listStatus(at) if not st.getPath().getName().startswith(("_", "."))]
    for f in files:
        to, _ = _hadoop_path(spark, f"{src}/{prefix}{f.getName()}")
        if not fs.rename(f, to):
            raise RuntimeError(f"could not move {f} to {to}")
    return len(files)


def quantile_slice(rows: DataFrame, order: Column, slices: int) -> Column:
    """The number of a row's slice when ``order`` (a number) is cut into about equal slices; the cuts, one
    less than the slices, are found by an approximate percentile and come to the driver."""
    cuts = rows.select(order.alias("o")).agg(F.percentile_approx("o", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    return sum((F.when(order >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))


def run_to_files(df: DataFrame, name: str, mode: str = "append", view: str | None = None,
                 checkpoint: str | None = None, out: str | None = None) -> tuple[StreamingQuery, str]:
    """Start ``df`` into a parquet file sink (append) or an overwrite-per-batch table
    (complete/update); with ``view=None`` wait until the available input is processed."""
    spark = df.sparkSession
    checkpoint = checkpoint or shared_dir(spark, f"{name}-ckpt")
    out = out or shared_dir(spark, f"{name}-out")
    w = df.writeStream.queryName(f"{name}_{abs(hash(out)) % 10**8}").option("checkpointLocation", checkpoint) \
        .trigger(**trigger_for(view))
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        def overwrite(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode(mode).foreachBatch(overwrite).start()
    if view is None:
        q.awaitTermination()
    return q, out
