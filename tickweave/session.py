"""Session helpers: one place for the configuration the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tickweave") -> SparkSession:
    """Build (or reuse) a session with the settings the plans are tuned for.

    AQE is on so that shuffle partition counts coalesce at runtime and skewed joins split;
    the session zone is UTC so that dates and timestamps agree with the DuckDB oracle.  Shuffle
    partitions and driver memory are set only when asked for or on a local master.
    """
    master = master or os.environ.get("TICKWEAVE_MASTER")  # None: spark-submit's master (or local[*])
    parts = shuffle_partitions or os.environ.get("TICKWEAVE_SHUFFLE_PARTITIONS")
    memory = os.environ.get("TICKWEAVE_DRIVER_MEMORY")
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if (master or "").startswith("local"):  # a cluster's own settings stay as submitted
        parts, memory = parts or 8, memory or "16g"
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    builder = (
        builder
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session. Only when it is unset *and* the master is local
    (tests, a laptop) do we create one, because a machine-local folder is useless to a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="tickweave-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freed_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """While it holds, a query's shuffle files go as soon as the query has ended, not when the driver's garbage
    collector finds them unused (Spark 4.1 on; older ones know no such setting and keep them)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [(s, s.conf.get(key, None)) for s in sessions]
    for s in sessions:
        s.conf.set(key, "true")
    try:
        yield
    finally:
        for s, value in before:
            s.conf.unset(key) if value is None else s.conf.set(key, value)


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and return a frame that reads it back.

    Used where several branches of one plan read the same expensive intermediate (Spark
    reuses shuffles, not window or aggregate outputs) and to cut long lineages, so a lost
    executor costs a re-read of the checkpoint rather than a recomputation from the raw
    tables.  A reliable ``checkpoint`` — never ``localCheckpoint``, whose blocks die with
    their executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(base if base else shared_dir(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def materialize_table(df, name: str = "table"):
    """As :func:`materialize`, written as Parquet: later readers take only the columns they use, and the
    plan knows the table's size."""
    out = shared_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
