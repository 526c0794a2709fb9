"""Shared pieces of the training-data operators: table reads, shared-folder tables, tokenizer paths
and the text conventions of the contracts (ASCII white space, ASCII lower case)."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tickweave.session import shared_dir
from tickweave.sources.tables import read_table

#: Characters that part words in every contract: blank, tab, newline, VT, FF, CR.
ASCII_WS = "\\x20\\x09-\\x0D"
ARROW_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: later passes re-read a
    file that every executor sees, so a lost executor never re-runs what came before."""
    spark = df.sparkSession
    out = shared_dir(spark, name)
    with arrow_rows(spark, ARROW_ROWS):
        df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, an Arrow batch has at most ``rows`` rows: whole texts of 10,000 rows (Spark's default) take
    some hundred MB outside the heap, for every task that runs and once more in its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, as ``--py-files`` would: Spark copies
    the archive to every executor, also to ones that join later."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="tickweave-py-"), "tickweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_name(df_columns, base: str) -> str:
    """``base``, lengthened until no column has that name (case-insensitively, as Spark compares)."""
    taken = {c.lower() for c in df_columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_chunks(texts, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) pieces of about ``limit`` characters, null as empty; a text is never cut. An Arrow
    column becomes Python texts some rows at a time, so a worker never holds a batch twice."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts if isinstance(texts, list) else column_values(texts)):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def column_values(column, rows: int = 256) -> Iterator:
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


_state: dict = {}


def per_process(key, build: Callable):
    """A value built once per Python worker (a loaded vocabulary, a word cache). Workers are reused by
    later stages, so only the latest one is held."""
    if key not in _state:
        _state.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _state[key] = build()
    return _state[key]


class BoundedCache(dict):
    """A dict that is emptied when it holds ``limit`` entries: memory stays bounded, results don't change."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()
