"""Tables of whole versions behind an atomic pointer, for refreshed views, stream state and exports.

A plain overwrite leaves a moment without files, and a reader that falls into it sees no table or half of
one.  Here every version is a folder of its own; it exists for readers from the moment an empty file
named after it appears among the commits (one create-if-absent call, atomic on HDFS and object stores),
and the newest name is the table.  Versions are numbered by their writer - a stream's batch id - so a
batch that runs again after a failure makes another attempt at the same number, which takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """The versions under ``path``: ``data/<version>.<attempt>`` and ``commits/<version>.<attempt>``.

    One writer at a time. ``keep`` newest versions stay, so a reader that has just taken one still finds
    its files while ``keep - 1`` newer ones are written."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, fmt: str = "parquet"):
        if keep < 2:
            raise ValueError("readers need the version before the newest one")
        self.spark, self.path, self.keep, self.fmt = spark, path.rstrip("/"), keep, fmt

    def _fs(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[tuple[int, int]]:
        """(version, attempt) names in a folder, ascending: one driver-side listing of at most a few names."""
        path, fs = self._fs(folder)
        if not fs.exists(path):
            return []
        names = (st.getPath().getName().split(".") for st in fs.listStatus(path))
        return sorted((int(n[0]), int(n[1])) for n in names if len(n) == 2 and n[0].isdigit() and n[1].isdigit())

    @staticmethod
    def _name(entry: tuple[int, int]) -> str:
        return f"{entry[0]:019d}.{entry[1]:06d}"

    def version(self, below: int | None = None) -> int | None:
        """The newest version (before ``below``, for a batch that may run again); None before the first."""
        found = [e for e in self._listed("commits") if below is None or e[0] < below]
        return found[-1][0] if found else None

    def read(self, below: int | None = None, schema=None, **options) -> DataFrame | None:
        """The newest whole version (before ``below``); None before the first."""
        found = [e for e in self._listed("commits") if below is None or e[0] < below]
        if not found:
            return None
        reader = self.spark.read.options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.format(self.fmt).load(f"{self.path}/data/{self._name(found[-1])}")

    def write(self, df: DataFrame, version: int, partition_by=(), **options) -> None:
        """Write ``df`` as this version and make it the table; versions from before the kept ones go."""
        before = self._listed("commits")
        if before and before[-1][0] > version:
            raise ValueError(f"version {version} is older than the table's {before[-1][0]}")
        tried = [a for v, a in self._listed("data") if v == version]
        entry = (version, max(tried, default=0) + 1)
        writer = df.write.options(**options).format(self.fmt)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(f"{self.path}/data/{self._name(entry)}")
        path, fs = self._fs(f"commits/{self._name(entry)}")
        fs.create(path, False).close()
        self._remove_old()

    def _remove_old(self) -> None:
        commits = self._listed("commits")
        newest = {e[0]: e for e in commits}  # the last attempt of each version
        kept = set(list(newest.values())[-self.keep:])
        for folder, entries in (("commits", commits), ("data", self._listed("data"))):  # the pointer goes first
            for e in entries:
                if e not in kept and e < max(kept):
                    path, fs = self._fs(f"{folder}/{self._name(e)}")
                    fs.delete(path, True)


def read_parts(spark: SparkSession, root: str, entries: list[tuple[str, int]], schema: str) -> DataFrame:
    """The rows of some ``root/f=<folder>/part=<number>`` folders, with their ``part``; nothing else is listed
    or read. ``schema`` names the columns in the files."""
    if not entries:
        return spark.createDataFrame([], f"{schema}, part int")
    return spark.read.option("basePath", root).schema(f"{schema}, f string, part int") \
        .parquet(*[f"{root}/f={f}/part={p}" for f, p in entries]).drop("f")


def remove_folders(table: VersionedTable, root: str, used: set[str]) -> None:
    """Delete the ``root/f=<folder>`` folders that are not in ``used``."""
    path = table.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(table.spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(path) if fs.exists(path) else []:
        if st.getPath().getName().removeprefix("f=") not in used:
            fs.delete(st.getPath(), True)
