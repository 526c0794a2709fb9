"""The exact "each url once" feed (T2) without reading its history: an index of the urls seen.

The index is cut by url hash into parts of bounded size, each with its urls and a Bloom filter over them.
A batch reads the filters of the parts that its urls fall into, and the urls of those parts only where a
filter says "perhaps"; a url that is new in its part's filter is new, without reading anything else.
When the parts have grown past their size their number is doubled and the index is written anew, so the
cost of a batch follows its own urls, not the history, and a url is rewritten a constant number of times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.feeds import unseen
from tickweave.streaming.versions import VersionedTable, read_parts, remove_folders

STATE = "part int, n long, files array<string>, bloom string, parts int"


class SeenIndex:
    """Urls seen so far under ``path``, at most about ``part_urls`` in a part.

    ``state`` has a row per part (its url folders and its filter's folder), the only thing that a batch
    reads whole: some bytes per ``part_urls`` urls. ``last_read`` tells what the last batch read."""

    BITS_PER_URL, HASHES, MOST_FILES = 16, 4, 64

    def __init__(self, spark: SparkSession, path: str, part_urls: int = 16_384, first_parts: int = 16):
        self.spark, self.path, self.part_urls, self.first_parts = spark, path.rstrip("/"), part_urls, first_parts
        self.bits = 64 * -(-2 * part_urls * self.BITS_PER_URL // 64)  # parts are uneven, and grow until they are cut
        self.state = VersionedTable(spark, f"{self.path}/state")
        self.last_read: dict[str, int] = {}

    # the hash decides the part, its bits in the filter come from other seeds
    @staticmethod
    def _hash() -> Column:
        return F.xxhash64(F.col("url"), F.col("url").isNull())

    def _bits(self) -> Column:
        one, two = (F.pmod(F.xxhash64(F.col("h"), F.lit(k)), F.lit(self.bits)) for k in (1, 2))
        return F.array(*[F.pmod(one + F.lit(k) * two, F.lit(self.bits)).cast("int") for k in range(self.HASHES)])

    def _folders(self, kind: str, entries: list[tuple[str, int]], schema: str) -> DataFrame:
        return read_parts(self.spark, f"{self.path}/{kind}", entries, schema)

    def _filters(self, urls: DataFrame, old: DataFrame) -> DataFrame:
        """(part, words): the filters of parts, with more urls in them."""
        bits = urls.select("part", F.explode(self._bits()).alias("b"))
        ones = bits.select("part", F.expr("b div 64").cast("int").alias("w"), F.expr("shiftleft(1L, b % 64)").alias("v"))
        was = old.select("part", F.posexplode("words").alias("w", "v"))
        # a new part's words are all there too, so a filter is its words in order and none is looked up
        every = F.explode(F.sequence(F.lit(0), F.lit(self.bits // 64 - 1)))
        none = urls.select("part").distinct().select("part", every.alias("w"), F.lit(0).cast("long").alias("v"))
        words = ones.unionByName(was).unionByName(none).groupBy("part", "w").agg(F.bit_or("v").alias("v"))
        inorder = F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])
        return words.groupBy("part").agg(inorder.alias("words"))

    def _perhaps(self) -> Column:
        """Whether all of a url's bits are set in its part's ``words``."""
        return F.forall(self._bits(), lambda b: F.getbit(F.get("words", F.floor(b / 64).cast("int")), b % 64) == 1)

    def add(self, urls: DataFrame, batch_id: int) -> DataFrame:
        """Add a batch's distinct urls (column ``url``, null being one); the ones that were not there, as
        a frame (url, h). The index counts as of before ``batch_id``, however often that batch runs."""
        state = self.state.read(below=batch_id)
        if state is None:
            state, parts = self.spark.createDataFrame([], STATE), self.first_parts
        else:
            sizes = state.agg(F.first("parts").alias("parts"), F.sum("n").alias("n"), F.max(F.size("files")).alias("files")).first()
            parts = sizes.parts
            if sizes.n > parts * self.part_urls or sizes.files > self.MOST_FILES:
                while sizes.n > parts * self.part_urls / 2:
                    parts *= 2
                state = self._rewritten(state, parts, f"{batch_id:012d}-{uuid.uuid4().hex[:8]}-whole")
        rows = urls.select("url", self._hash().alias("h")).withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).persist()
        # one row per part that the batch falls into: as many as the batch has urls or the index parts, at most
        hit = {r.part: r for r in rows.select("part").distinct().join(state, "part", "left").collect()}
        there = [(r.bloom, p) for p, r in hit.items() if r.bloom]
        filters = self._folders("bloom", there, "words array<long>").persist()
        maybe = rows.join(filters, "part").filter(self._perhaps()).select("url", "h", "part").persist()
        doubtful = {r.part for r in maybe.select("part").distinct().collect()} if there else set()
        read = [(f, p) for p in doubtful for f in hit[p].files]
        known = self._folders("urls", read, "url string, h long").persist()
        self.last_read = {"parts": parts, "parts_hit": len(there), "parts_read": len(doubtful), "urls_read": known.count() if read else 0}
        known = known.select(F.col("url").alias("k_url"), F.col("h").alias("k_h"))
        old = maybe.join(known, (maybe["h"] == known["k_h"]) & maybe["url"].eqNullSafe(known["k_url"]), "left_semi")
        old = old.select(F.col("h").alias("o_h"), F.col("url").alias("o_url"))
        fresh = rows.join(old, (rows["h"] == old["o_h"]) & rows["url"].eqNullSafe(old["o_url"]), "left_anti") if read else rows
        name = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        fresh.repartition("part").write.partitionBy("part").parquet(f"{self.path}/urls/f={name}")
        fresh = self.spark.read.schema("url string, h long, part int").parquet(f"{self.path}/urls/f={name}")
        more = {r.part: r.more for r in fresh.groupBy("part").agg(F.count(F.lit(1)).alias("more")).collect()}
        touched = self.spark.createDataFrame(
            [(p, n + (hit[p].n or 0), [*(hit[p].files or []), name], name, parts) for p, n in more.items()], STATE).coalesce(1)
        was = filters.join(touched.select("part"), "part", "left_semi")
        self._filters(fresh, was).repartition("part").write.partitionBy("part").parquet(f"{self.path}/bloom/f={name}")
        self.state.write(state.join(touched.select("part"), "part", "left_anti").unionByName(touched), batch_id)
        for held in (rows, filters, maybe):
            held.unpersist()
        return fresh.select("url", "h")

    def _rewritten(self, state: DataFrame, parts: int, name: str) -> DataFrame:
        """The index in ``parts`` parts, one folder each; the state of the new folders. Folders that no kept
        state names go."""
        entries = [(f, r.part) for r in state.select("part", "files").collect() for f in r.files]
        urls = self._folders("urls", entries, "url string, h long").withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        urls.repartition("part").write.partitionBy("part").parquet(f"{self.path}/urls/f={name}")
        urls = self.spark.read.schema("url string, h long, part int").parquet(f"{self.path}/urls/f={name}")
        none = self.spark.createDataFrame([], "words array<long>, part int")
        self._filters(urls, none).repartition("part").write.partitionBy("part").parquet(f"{self.path}/bloom/f={name}")
        self._remove_unused(name)
        return urls.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
            "part", "n", F.array(F.lit(name)).alias("files"), F.lit(name).alias("bloom"), F.lit(parts).alias("parts"))

    def _remove_unused(self, name: str) -> None:
        used, below = {name}, None
        names = lambda s: {r[0] for r in s.select(F.explode(F.concat("files", F.array("bloom")))).distinct().collect()}
        while (old := self.state.read(below=below)) is not None:
            used |= names(old)
            below = self.state.version(below=below)
        for kind in ("urls", "bloom"):
            remove_folders(self.state, f"{self.path}/{kind}", used)


class IndexedNews:
    """The exact T2 feed as a ``foreachBatch`` writer (``write``): articles whose url was neither in ``seen``
    nor in an earlier batch, the first in feed order inside a batch.  [T2]

    Like :func:`tickweave.streaming.streams.unseen_batch_writer`, with the index in place of all earlier
    batches. Rows go to ``path/news/batch_id=<id>``; a batch that runs again writes the same rows."""

    def __init__(self, spark: SparkSession, seen: DataFrame, path: str, **index):
        self.seen, self.path = seen, path.rstrip("/")
        self.index = SeenIndex(spark, f"{self.path}/index", **index)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        firsts = unseen(batch, self.seen).persist()
        fresh = self.index.add(firsts.select("url"), batch_id).select(F.col("url").alias("f_url"), F.lit(True).alias("fresh"))
        firsts.join(fresh, firsts["url"].eqNullSafe(fresh["f_url"]), "left_semi") \
            .write.mode("overwrite").parquet(f"{self.path}/news/batch_id={batch_id}")
        firsts.unpersist()

    def news(self) -> DataFrame:
        return self.index.spark.read.parquet(f"{self.path}/news")
