"""Live indicators with bars of any age (T5) and live alerts in both directions (T6).

Both are ``foreachBatch`` writers whose state lies in versioned tables under one folder, so a batch that
runs again after a failure reads the state from before it and writes the same rows again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.indicators import add_indicators, gain, indicator_lookback, loss
from tickweave.operators.feeds import crossings
from tickweave.session import freed_shuffles
from tickweave.sources.bars import BAR_COLUMNS, ts_seq_key
from tickweave.streaming.versions import VersionedTable, remove_folders

# --- T5 -------------------------------------------------------------------------------------------


#: Cells that may be broadcast (symbol, month, folder), some 20 MB; more are joined by an exchange.
BROADCAST_CELLS = 100_000


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


class LiveIndicators:
    """Indicators of all bars received so far, whatever the order they arrive in.  [T5]

    The table is kept in cells, one per symbol and month; a state row per cell holds its number of bars
    and the folder of its newest form.  Every indicator looks back at most L rows, so a bar changes
    the cells from its own up to those that begin within L rows after its month, and these need the L
    rows before that month.  Running sums of the state's counts say which cells these are without reading
    any bar; only they are read, computed by the batch code and written again.  An ordinary batch of
    newest bars reads each symbol's last L rows' cells and writes one; a bar that is years late rewrites
    the cells around its own date.

    Use ``write`` with ``foreachBatch``, ``current`` to read. A bar sent again replaces the one before;
    of several in one batch the greatest (by close, then the other values) stays. A bar without a date
    belongs to no cell and is left out; a null symbol is a series of its own. An empty batch changes
    nothing. ``compact_every`` batches the cells are gathered into one folder and unused ones go; a month
    of a folder is at most ``month_files`` files, parted by symbol."""

    def __init__(self, spark: SparkSession, path: str, price_scale: int | None = None, compact_every: int = 64, month_files: int = 8):
        self.spark, self.path, self.month_files = spark, path.rstrip("/"), month_files
        self.price_scale, self.compact_every = price_scale, compact_every
        self.state = VersionedTable(spark, f"{self.path}/state")
        self.lookback = indicator_lookback()

    def _cells(self, state: DataFrame, columns: list[str], whole: str | None = None) -> DataFrame | None:
        """The rows of the cells in ``state``. Their folders and months are listed on the driver: as many
        as the calendar and the batches since the last compaction have, whatever the number of symbols. Of the folder
        ``whole`` every row counts; folders with a few cells left meet a broadcast, so their rows are not exchanged."""
        places = state.filter("v IS NOT NULL").groupBy("v", "month").agg(F.count(F.lit(1)).alias("cells")).collect()
        if not places:
            return None
        cells: dict[str, int] = {}
        for r in places:
            cells[r.v] = cells.get(r.v, 0) + r.cells
        few, held = set(), 0
        for v in sorted(cells, key=lambda v: (cells[v], v)):
            held += cells[v] if v != whole else 0
            if v != whole and held <= BROADCAST_CELLS:
                few.add(v)
        root, parts = f"{self.path}/rows", []
        own = state.select(F.col("symbol").alias("_symbol"), F.col("month").alias("_month"), F.col("v").alias("_v"),
                           *[c for c in state.columns if c not in ("symbol", "month", "v", "n")])
        for folders in (few, {whole} & set(cells), set(cells) - few - {whole}):
            if not folders:
                continue
            rows = self.spark.read.option("basePath", root).parquet(*[f"{root}/f={r.v}/month={r.month}" for r in places if r.v in folders])
            rows = rows.select(*columns, F.col("f").cast("string").alias("f"), F.col("month").cast("string").alias("month"))
            if whole not in folders:
                mine = own.filter(F.col("_v").isin(*folders))
                rows = rows.join(F.broadcast(mine) if folders is few else mine,
                                 rows["symbol"].eqNullSafe(own["_symbol"]) & (rows["month"] == own["_month"]) & (rows["f"] == own["_v"])) \
                    .drop("_symbol", "_month", "_v")
            parts.append(rows.drop("f"))
        return reduce(DataFrame.unionByName, parts)

    def plan(self, old: DataFrame, touched: DataFrame) -> DataFrame:
        """(symbol, month, n, v, emit): the cells that a batch with bars in the ``touched`` ones reads, and
        whether it writes them again."""
        months = (old.select("symbol", "month", "n", "v", F.lit(False).alias("t"))
                  .unionByName(touched.select("symbol", "month", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("v"), F.lit(True).alias("t")))
                  .groupBy("symbol", "month").agg(F.sum("n").alias("n"), F.max("v").alias("v"), F.max("t").alias("t")))
        w = Window.partitionBy("symbol").orderBy("month")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        months = months.withColumn("through", F.sum("n").over(so_far)).withColumn("before", F.col("through") - F.col("n"))
        last = F.max(F.when(F.col("t"), F.col("through"))).over(so_far)  # rows up to the last touched month
        following = F.min(F.when(F.col("t"), F.col("before"))).over(w.rowsBetween(0, Window.unboundedFollowing))
        months = months.withColumn("emit", F.coalesce(F.col("before") - last < self.lookback, F.lit(False))) \
            .withColumn("needed", F.coalesce(following - F.col("through") < self.lookback, F.lit(False)))
        return months.filter("emit OR needed").select("symbol", "month", "n", "v", "emit")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in BAR_COLUMNS if c not in ("symbol", "date")]
        values = ["close", *[c for c in rest if c != "close"]]
        new = (batch.select(*BAR_COLUMNS).filter("date IS NOT NULL").groupBy("symbol", "date")
               .agg(F.max(F.struct(*values)).alias("b")).select("symbol", "date", *[F.col(f"b.{c}").alias(c) for c in rest])
               .select(*BAR_COLUMNS).persist())
        with freed_shuffles(self.spark, batch.sparkSession):
            try:
                if not new.isEmpty():
                    self._write(new, batch_id)
            finally:
                new.unpersist()
            if batch_id % self.compact_every == self.compact_every - 1:
                self.compact()

    def _write(self, new: DataFrame, batch_id: int) -> None:
        old = self.state.read(below=batch_id)
        if old is None:
            old = self.spark.createDataFrame([], "symbol string, month string, n long, v string")
        touched = new.select("symbol", month_of().alias("month")).distinct()
        cells = self.plan(old, touched).persist()
        frame = new.withColumn("emit", F.lit(True))
        there = self._cells(cells, BAR_COLUMNS)
        if there is not None:
            # exchanged once, by symbol: a bar sent again meets the one before where the indicators are computed
            both = frame.withColumn("_new", F.lit(True)).unionByName(there.select(*BAR_COLUMNS, "emit", F.lit(False).alias("_new"))).repartition("symbol")
            again = F.max("_new").over(Window.partitionBy("symbol", "date"))
            frame = both.withColumn("_again", again).filter("_new OR NOT _again").drop("_new", "_again")
        rows = add_indicators(frame, price_scale=self.price_scale).filter("emit").drop("emit")
        name = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"  # an attempt of its own: what readers hold stays as it is
        folder = f"{self.path}/rows/f={name}"
        self._store(rows, folder)
        cells.unpersist()
        done = self.spark.read.parquet(folder).groupBy("symbol", F.col("month").cast("string").alias("month")) \
            .agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.lit(name))
        other = done.select(F.col("symbol").alias("_s"), F.col("month").alias("_m"))
        kept = old.join(other, old["symbol"].eqNullSafe(other["_s"]) & (old["month"] == other["_m"]), "left_anti")
        self.state.write(kept.unionByName(done), batch_id)

    def _store(self, rows: DataFrame, folder: str) -> None:
        """``rows`` by month. What follows from a row's other columns is left out of the exchange and computed behind it."""
        narrow = rows.drop("gain", "loss", "month").repartition(month_of(), F.pmod(F.xxhash64("symbol"), F.lit(self.month_files)))
        again = narrow.withColumns({"gain": gain(F.col("change")), "loss": loss(F.col("change"))})
        (again.select(*[c for c in rows.columns if c != "month"], month_of().alias("month"))
         .write.partitionBy("month").option("compression", "zstd").parquet(folder))

    def current(self) -> DataFrame | None:
        """All bars with their indicators; None before the first batch."""
        state = self.state.read()
        if state is None:
            return None
        newest = state.agg(F.max("v")).first()[0]  # folders begin with their batch: no later one took a cell of this
        columns = [c for c in self.spark.read.parquet(f"{self.path}/rows/f={newest}").columns if c != "month"]
        return self._cells(state, columns, whole=newest).drop("month")

    def compact(self) -> None:
        """All cells into one folder, then folders that no kept state names go."""
        version = self.state.version()
        if version is None:
            return
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        self._store(self.current(), f"{self.path}/rows/f={name}")
        self.state.write(self.state.read().withColumn("v", F.lit(name)), version)
        used, below = {name}, version
        while (old := self.state.read(below=below)) is not None:
            used |= {r.v for r in old.select("v").distinct().collect()}
            below = self.state.version(below=below)
        remove_folders(self.state, f"{self.path}/rows", used)


# --- T6 -------------------------------------------------------------------------------------------

class LiveAlerts:
    """Saved alerts against live ticks, upwards and downwards, each fired once by the first tick whose price
    has crossed it since the symbol's tick before: the live form of J4.  [T6]

    The last tick of every symbol is kept between batches, so a crossing between two batches counts like
    one within a batch. A symbol's first tick crosses nothing. Ticks that arrive with or after a later
    one of their symbol from an earlier batch, and ticks without time or price, move nothing.

    No task takes a whole symbol: neighbours are found within (symbol, ``slot``) - an hour of ticks by
    default - and the price before a slot comes from the slots' last prices, one row each.

    Only the first tick to cross an alert counts, so only ticks beyond all prices before them meet alerts
    (:func:`first_reaches`): an alert above the price that the batch starts from is first crossed by the tick
    that first reaches it, a new highest price, one below by a new lowest. Each alert meets one tick, by price
    bucket (:func:`tickweave.operators.feeds.crossings`), however many ticks cross it later."""

    SCHEMA = "alert_id long, symbol string, alert_price double, direction string, ts timestamp, seq long, prev_price double, price double, batch_id long"

    def __init__(self, spark: SparkSession, alerts: DataFrame, path: str, slot: str = "hour"):
        self.spark, self.alerts, self.slot = spark, alerts.select("alert_id", "symbol", "price"), slot
        self.last = VersionedTable(spark, f"{path.rstrip('/')}/last")
        self.fired = VersionedTable(spark, f"{path.rstrip('/')}/fired")

    def moves(self, ticks: DataFrame, last: DataFrame | None) -> DataFrame:
        """(symbol, ts, seq, prev_close, close, high, low, start) of ticks that moved the price: the highest and
        lowest price of the batch before each, and the first one, the known last tick of the symbol included."""
        rows = ticks.withColumn("old", F.lit(False))
        if last is not None:
            known = last.select(F.col("symbol").alias("_s"), ts_seq_key(F.col("ts"), F.col("seq")).alias("_k"))
            rows = rows.join(known, rows["symbol"].eqNullSafe(known["_s"]), "left") \
                .filter(F.col("_k").isNull() | (ts_seq_key(F.col("ts"), F.col("seq")) > F.col("_k"))).drop("_s", "_k")
            rows = rows.unionByName(last.withColumn("old", F.lit(True)))
        rows = rows.withColumn("slot", F.date_trunc(self.slot, "ts"))
        at = ts_seq_key(F.col("ts"), F.col("seq"))
        ends = rows.groupBy("symbol", "slot").agg(
            F.max_by("price", at).alias("end"), F.min_by("price", at).alias("begin"), F.max("price").alias("top"), F.min("price").alias("bottom"))
        by_slot = Window.partitionBy("symbol").orderBy("slot")
        so_far = by_slot.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col("symbol").alias("_s"), F.col("slot").alias("_slot"), F.lag("end").over(by_slot).alias("carried"),
                           F.max("top").over(so_far).alias("top"), F.min("bottom").over(so_far).alias("bottom"),
                           F.first("begin").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
        in_slot = Window.partitionBy("symbol", "slot").orderBy("ts", "seq")
        before = in_slot.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({"within": F.lag("price").over(in_slot), "above": F.max("price").over(before), "below": F.min("price").over(before)})
        rows = rows.join(ends, rows["symbol"].eqNullSafe(ends["_s"]) & (rows["slot"] == ends["_slot"]))
        prev = F.coalesce("within", "carried")
        return rows.filter(~F.col("old") & prev.isNotNull() & (prev != F.col("price"))) \
            .select("symbol", "ts", "seq", prev.alias("prev_close"), F.col("price").alias("close"),
                    F.greatest("above", "top").alias("high"), F.least("below", "bottom").alias("low"), "start")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of ticks (symbol, ts, seq, price)."""
        ticks = batch.select("symbol", "ts", "seq", "price").filter("ts IS NOT NULL AND price IS NOT NULL AND seq IS NOT NULL")
        last, fired = self.last.read(below=batch_id), self.fired.read(below=batch_id)
        if fired is None:
            fired = self.spark.createDataFrame([], self.SCHEMA)
        waiting = self.alerts.join(fired.select("alert_id"), "alert_id", "left_anti")
        reaches = first_reaches(self.moves(ticks, last)).persist()
        met = crossings(reaches, waiting)
        at = ts_seq_key(F.col("ts"), F.col("seq"))
        hit = met.groupBy("alert_id", "symbol", "alert_price").agg(
            *[F.min_by(c, at).alias(c) for c in ("direction", "ts", "seq", "before", "close")])
        hit = hit.select("alert_id", "symbol", "alert_price", "direction", "ts", "seq", F.col("before").alias("prev_price"),
                         F.col("close").alias("price"), F.lit(batch_id).cast("long").alias("batch_id"))
        self.fired.write(fired.unionByName(hit), batch_id)
        reaches.unpersist()
        rows = ticks if last is None else ticks.unionByName(last)
        self.last.write(rows.groupBy("symbol").agg(*[F.max_by(c, at).alias(c) for c in ("ts", "seq", "price")]), batch_id)

    def fired_so_far(self) -> DataFrame:
        found = self.fired.read()
        return self.spark.createDataFrame([], self.SCHEMA) if found is None else found


def first_reaches(moves: DataFrame) -> DataFrame:
    """``moves`` as the stretches of price that each is the first to reach: ``close`` and, as ``prev_close``, the
    highest or lowest price before; ``before`` is the price before. A level is in one stretch of its symbol at
    most, but for the start price: the first move to cross that again is a row of its own."""
    reach = F.when(F.col("close") > F.col("high"), F.col("high")).when(F.col("close") < F.col("low"), F.col("low"))
    columns = ["symbol", "ts", "seq", "close", F.col("prev_close").alias("before")]
    records = moves.select(*columns, reach.alias("prev_close")).filter("prev_close IS NOT NULL")
    back = moves.filter(((F.col("prev_close") < F.col("start")) & (F.col("start") <= F.col("close")))
                        | ((F.col("prev_close") > F.col("start")) & (F.col("start") >= F.col("close"))))
    at = ts_seq_key(F.col("ts"), F.col("seq"))
    # crosses other levels too, once a symbol: the caller takes the earliest of an alert's crossings
    back = back.groupBy("symbol").agg(*[F.min_by(c, at).alias(c) for c in ("ts", "seq", "close", "prev_close")])
    return records.unionByName(back.select(*columns, "prev_close"))
