"""Portfolio totals kept current by price changes (A1), and the rotating news card over a growing feed (L2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickweave.operators.portfolio import clean_holdings
from tickweave.sources.bars import ts_seq_key
from tickweave.streaming.versions import VersionedTable, read_parts, remove_folders


def _and(schema: StructType, more: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(more).fields)


class LivePortfolios:
    """Totals of every portfolio, moved by quantity x price change of the symbols whose price changed.  [A1]

    ``load`` cleans the holdings (P3) and stores one position per portfolio and symbol, dealt into
    ``parts`` by symbol. A micro-batch of quotes (``write``) takes the newest price of each symbol, reads
    only the parts that hold a changed symbol, and appends one delta row per portfolio that holds one;
    a holding counts from its symbol's first price on, as an unpriced one is left out of the totals.
    ``totals`` sums the deltas since the last fold; every ``fold_every`` batches they become one folder.

    Quotes without symbol, time, sequence number or price, and those older than the known one, change
    nothing. A batch that runs again replaces its own delta."""

    POSITION = "portfolio_id long, symbol string, n long, quantity double, cost double"
    DELTA = "portfolio_id long, n long, cost double, value double"

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, fold_every: int = 32):
        self.spark, self.path, self.parts, self.fold_every = spark, path.rstrip("/"), parts, fold_every
        self.prices = VersionedTable(spark, f"{self.path}/prices")
        self.log = VersionedTable(spark, f"{self.path}/log")  # the delta folders that make up the totals

    def load(self, holdings: DataFrame) -> None:
        rows = clean_holdings(holdings).groupBy(F.col("portfolio_id").cast("long").alias("portfolio_id"), "symbol").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity").cast("double")).alias("quantity"), F.sum(F.col("buy_price") * F.col("quantity")).alias("cost"))
        rows.withColumn("part", self._part()).repartition("part", F.pmod(F.xxhash64("portfolio_id"), F.lit(8))).sortWithinPartitions("symbol") \
            .write.partitionBy("part").parquet(f"{self.path}/positions/f=all")

    def _part(self):
        return F.pmod(F.xxhash64("symbol"), F.lit(self.parts)).cast("int")

    def write(self, quotes: DataFrame, batch_id: int) -> None:
        """A batch of quotes (symbol, ts, seq, price)."""
        at = ts_seq_key(F.col("ts"), F.col("seq"))
        known = quotes.select("symbol", "ts", "seq", "price").filter(
            "symbol IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL AND price IS NOT NULL")
        new = known.groupBy("symbol").agg(*[F.max_by(c, at).alias(c) for c in ("ts", "seq", "price")])
        old = self.prices.read(below=batch_id)
        if old is None:
            old = new.filter("false")
        was = old.select("symbol", F.col("price").alias("old_price"), at.alias("old_at"))
        moved = new.join(was, "symbol", "left").filter(F.col("old_at").isNull() | (at > F.col("old_at"))).drop("old_at") \
            .withColumn("part", self._part()).persist()
        parts = [r.part for r in moved.filter("old_price IS NULL OR old_price != price").select("part").distinct().collect()]  # at most ``parts``
        held = read_parts(self.spark, f"{self.path}/positions", self._there(parts), self.POSITION)
        first = F.col("old_price").isNull()
        delta = held.drop("part").join(moved.select("symbol", "price", "old_price"), "symbol").groupBy("portfolio_id").agg(
            F.sum(F.when(first, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(first, F.col("cost")).otherwise(0.0)).alias("cost"),
            F.sum(F.col("quantity") * (F.col("price") - F.coalesce("old_price", F.lit(0.0)))).alias("value"))
        name = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        delta.write.parquet(f"{self.path}/deltas/f={name}")
        merged = old.join(moved.select("symbol"), "symbol", "left_anti").unionByName(moved.select("symbol", "ts", "seq", "price"))
        self.prices.write(merged, batch_id)
        folders = self._log(batch_id) + [name]
        if len(folders) > self.fold_every:
            name = f"{name}-fold"
            self._sums(folders).write.parquet(f"{self.path}/deltas/f={name}")
            folders = [name]
        self.log.write(self.spark.createDataFrame([(f,) for f in folders], "f string").coalesce(1), batch_id)
        if len(folders) == 1:
            self._clean()
        moved.unpersist()

    def _there(self, parts: list[int]) -> list[tuple[str, int]]:
        """The parts that have positions at all."""
        path, fs = self.log._fs("../positions/f=all")
        names = {st.getPath().getName() for st in fs.listStatus(path)}
        return [("all", p) for p in parts if f"part={p}" in names]

    def _log(self, below: int | None = None) -> list[str]:
        found = self.log.read(below=below, schema="f string")
        return [] if found is None else sorted(r.f for r in found.collect())  # at most ``fold_every`` names

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.DELTA)
        rows = self.spark.read.schema(self.DELTA).parquet(*[f"{self.path}/deltas/f={f}" for f in folders])
        return rows.groupBy("portfolio_id").agg(*[F.sum(c).alias(c) for c in ("n", "cost", "value")])

    def _clean(self) -> None:
        used, below = set(), None
        while (version := self.log.version(below=below)) is not None:
            used |= set(self._log(version + 1))
            below = version
        remove_folders(self.log, f"{self.path}/deltas", used)

    def totals(self) -> DataFrame:
        """The columns of :func:`tickweave.operators.portfolio.portfolio_totals`."""
        sums = self._sums(self._log()).filter("n > 0")
        pnl = F.col("value") - F.col("cost")
        return sums.select(
            "portfolio_id", F.col("n").alias("n_holdings"), F.col("cost").alias("total_cost"), F.col("value").alias("total_value"),
            pnl.alias("total_pnl"), F.when(F.col("cost") != 0, pnl / F.col("cost") * F.lit(100.0)).otherwise(F.lit(0.0)).alias("total_return_pct"))


class LiveRotation:
    """The rotating pick (L2) over a feed that grows: per group, the item at position ``k mod count``.  [L2]

    Positions are cut into buckets of ``width``; the state has a count per group and bucket, and the
    folders that hold the bucket. A batch adds its counts and writes its items once. A pick finds each
    group's bucket by running sums over the counts and reads only the folders of the buckets it picks
    from, whatever the length of the feed. Items without a position are left out; a null group is one."""

    def __init__(self, spark: SparkSession, path: str, group_col: str, order_col: str = "feed_pos", width: int = 1024):
        self.spark, self.path = spark, path.rstrip("/")
        self.group, self.order, self.width = group_col, order_col, width
        self.state = VersionedTable(spark, f"{self.path}/state")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        part = F.floor(F.col(self.order) / F.lit(self.width)).cast("int")
        batch.filter(F.col(self.order).isNotNull()).withColumn("part", part).repartition("part") \
            .write.partitionBy("part").parquet(f"{self.path}/items/f={name}")
        new = self.spark.read.schema(_and(batch.schema, "part int")).parquet(f"{self.path}/items/f={name}") \
            .groupBy(F.col(self.group).alias("g"), "part").agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.array(F.lit(name)))
        old = self.state.read(below=batch_id)
        rows = new if old is None else old.unionByName(new)
        self.state.write(rows.groupBy("g", "part").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("files")).alias("files")), batch_id)

    def pick(self, k: int, schema) -> DataFrame:
        """The picked items (columns ``schema``, a StructType) with ``n_items`` and ``pick_index``, as
        :func:`tickweave.operators.feeds.rotating_pick` gives them."""
        state = self.state.read()
        by = Window.partitionBy("g")
        upto = F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        counts = state.withColumn("upto", upto).withColumn("total", F.sum("n").over(by))
        target = F.pmod(F.lit(k), F.col("total"))
        found = counts.filter((F.col("upto") - F.col("n") <= target) & (target < F.col("upto"))).select(
            "g", F.col("part").alias("p"), "files", (target - F.col("upto") + F.col("n")).alias("off"), "total").persist()
        # the folders to read: buckets of the feed, not its groups or items
        entries = [(r.f, r.p) for r in found.select(F.explode("files").alias("f"), "p").distinct().collect()]
        root = f"{self.path}/items"
        items = self.spark.read.option("basePath", root).schema(_and(schema, "f string, part int")) \
            .parquet(*[f"{root}/f={f}/part={p}" for f, p in entries]).drop("f") if entries else self.spark.createDataFrame([], _and(schema, "part int"))
        rows = items.join(found.drop("files"), items[self.group].eqNullSafe(found["g"]) & (items["part"] == found["p"]))
        place = F.row_number().over(Window.partitionBy(self.group, "part").orderBy(self.order)) - 1
        return rows.withColumn("place", place).filter("place = off").withColumn("n_items", F.col("total")) \
            .withColumn("pick_index", F.lit(k) % F.col("total")).drop("g", "p", "part", "off", "total", "place")
