"""Packing by cutting-stock column generation (operator 8).

1. Every text is tokenised where it lies and cut into full sequences plus one remainder; a piece is a
   small row (start, length, checksum), ids are never shuffled. Full pieces are sequences already.
2. The remainders' histogram over length classes (``QUANTUM`` tokens wide, at most
   ``seq_len / QUANTUM`` classes whatever the corpus) is counted with map-side combine and is all that
   reaches the driver. A linear program over cutting patterns is solved there by a revised simplex; an
   unbounded-knapsack dynamic program over the duals prices new patterns, until none improves.
3. Pattern counts are rounded down; what is left over per class is packed best-fit decreasing, which
   adds at most about one sequence per class of extra patterns.
4. Remainders are ranked within their class - by a count per (class, salt) and a prefix sum, so no
   class is sorted in one task - and the rank picks the pattern copy: (class, rank) -> sequence and
   slot is arithmetic over the pattern table, a constant bounded by the number of classes.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.common import BoundedCache, documents, map_arrow, per_process, saved, text_chunks, tokenizer_path

WORD_BPE = "word_bpe_49k.json"
SEQ_LEN = 2048
END_ID = 1
QUANTUM = 8
ROWS_PER_SALT = 50_000
CACHE_WORDS = 1_000_000
CHUNK_CHARS = 1 << 22


# --- tokens -------------------------------------------------------------------------------------

class ChunkTokenizer:
    """Ids of whole texts by the tokenizers library, asked once per distinct word.

    This vocabulary's normaliser and split rule never join characters across ASCII white space, so a
    text's ids are its white-space chunks' ids in order. ASCII letters may be lower-cased first, as the
    normaliser does, and a ``.`` or ``,`` that ends a chunk after an ASCII letter is a piece of its own,
    so such a chunk takes its stem's ids; texts that may hold a special token are left as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache = BoundedCache(CACHE_WORDS)

    @staticmethod
    def ended(word: bytes) -> bool:
        """Whether the last character is a piece of its own."""
        return word[-1:] in (b".", b",") and word[-2:-1].islower()

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.cache]  # a set difference would walk the whole cache
        if len(self.cache) + len(new) > self.cache.limit:
            self.cache.clear()
            new = list(words)
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.cache.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(new, encoded, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        words, ends = [], []
        for t in texts:
            raw = t.encode("utf-8", "replace")
            words += raw.split() if b"<|" in raw else raw.lower().split()
            ends.append(len(words))
        ids = list(map(self.cache.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        parted = [(i, words[i][:-1], words[i][-1:]) for i in unknown if self.ended(words[i])]
        whole = [i for i in unknown if not self.ended(words[i])]
        self.learn({b".", b","}.union((words[i] for i in whole), (stem for _, stem, _ in parted)))
        of = self.cache
        for i in whole:
            ids[i] = of[words[i]]
        for i, stem, stop in parted:  # not cached themselves: the cache stays as small as the stems
            ids[i] = of[stem] + of[stop]
        return [np.frombuffer(b"".join(ids[a:b]), self.kind).astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]


def chunk_tokenizer(path: str | None) -> ChunkTokenizer:
    path = path or tokenizer_path(WORD_BPE)
    return per_process(("word-bpe", path), lambda: ChunkTokenizer(path))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None, seq_len: int, end_id: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa
        coder, end = chunk_tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for first, part in text_chunks(batch.column(1), CHUNK_CHARS):
                row, start, length, crc, total = [], [], [], [], []
                for i, packed in enumerate(coder.encode_batch(part)):
                    packed += end
                    n = len(packed) // 4
                    for s in range(0, n, seq_len):
                        piece = packed[4 * s:4 * (s + seq_len)]
                        row.append(first + i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(rows, run, f"doc_id {kind}, {PIECES}")


# --- the plan -----------------------------------------------------------------------------------

def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern of items of weights 1..n (unbounded) with these values; (its value, its counts)."""
    n = min(len(value), capacity)
    value = value[:n]
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(c, n)
        got = value[:k] + best[c - k:c][::-1]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], item[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]  # this unit stays empty
    counts, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if item[c]:
            counts[item[c] - 1] += 1
            c -= item[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def greedy_basis(need: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray, int]]:
    """A first basis, as (amount, counts, exhausted class): patterns filled largest class first, each used (fractionally) until one of its
    classes is exhausted. The exhausted class is in no later pattern, so the columns are independent."""
    left, whole = need.astype(float), []
    while (left > 0).any():
        counts, room = np.zeros(len(left), np.int64), capacity
        for c in range(len(left), 0, -1):
            if left[c - 1] > 0 and c <= room:
                counts[c - 1] = k = min(room // c, max(1, int(left[c - 1])))
                room -= k * c
        inside = np.flatnonzero(counts)
        share = left[inside] / counts[inside]
        out = inside[int(share.argmin())]
        amount = float(share.min())
        left = np.maximum(left - amount * counts, 0)
        left[out] = 0.0
        left[left < 1e-9] = 0.0
        whole.append((amount, counts, int(out)))
    gone = {out for _, _, out in whole}  # classes that float error emptied along with another
    for c in np.flatnonzero(need):
        if int(c) not in gone:
            counts = np.zeros(len(left), np.int64)
            counts[c] = capacity // (c + 1)
            whole.append((0.0, counts, int(c)))
    return whole


def solve_patterns(need: np.ndarray, capacity: int, tolerance: float = 1e-3, most_rounds: int = 3000) -> list[tuple[float, np.ndarray]]:
    """Fractional optimum of: fewest patterns (columns) that cover ``need`` (classes 1..n, weight =
    class). Revised simplex from :func:`greedy_basis`; :func:`knapsack` over the duals prices new
    columns. The best price bounds the gap to the optimum (by 1 - 1 / price): it stops within
    ``tolerance`` of it, or after ``most_rounds`` pivots with the patterns it then has."""
    rows = np.flatnonzero(need)
    if not len(rows):
        return []
    m, row_of = len(rows), {int(c): i for i, c in enumerate(rows)}
    wanted = need[rows].astype(float)
    columns, inverse = np.eye(m), np.eye(m)

    def enter(column: np.ndarray, out: int, step: np.ndarray) -> None:
        columns[:, out] = column
        pivot = inverse[out] / step[out]
        np.subtract(inverse, step[:, None] * pivot, out=inverse)
        inverse[out] = pivot

    # plain elementwise products: m is at most a few hundred, and threaded BLAS is not fork-safe
    for _, counts, out in greedy_basis(need, capacity):
        column = counts[rows].astype(float)
        enter(column, row_of[out], (inverse * column).sum(axis=1))
    x = np.maximum((inverse * wanted).sum(axis=1), 0)
    for _ in range(most_rounds):
        value = np.zeros(capacity)
        value[rows] = np.maximum(inverse.sum(axis=0), 0)
        worth, counts = knapsack(value, capacity)
        if worth <= 1 + tolerance:
            break
        column = counts[rows].astype(float)
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        enter(column, out, step)
        x = np.maximum((inverse * wanted).sum(axis=1), 0)
    whole = []
    for k in range(m):
        counts = np.zeros(len(need), np.int64)
        counts[rows] = columns[:, k]
        whole.append((float(x[k]), counts))
    return whole


def best_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for the items that rounding left over: largest first into the fullest that fits."""
    bins: list[np.ndarray] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for c in range(len(left), 0, -1):
        for _ in range(int(left[c - 1])):
            room = next((r for r in range(c, capacity + 1) if by_room[r]), None)
            if room is None:
                room, i = capacity, len(bins)
                bins.append(np.zeros(len(left), np.int64))
            else:
                i = by_room[room].pop()
            bins[i][c - 1] += 1
            by_room[room - c].append(i)
    return bins


def cutting_plan(need: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """[(copies, items per class)] that hold every item: LP patterns rounded down, the rest best-fit.

    Rounding leaves less than one pattern per class, so ``best_fit`` sees at most
    ``classes * capacity`` items however large the corpus is."""
    need = need.astype(np.int64)
    left, plan = need.copy(), []
    for amount, counts in sorted(solve_patterns(need, capacity), key=lambda p: -p[0]):
        copies = int(amount + 1e-6)
        inside = counts > 0
        if copies and inside.any():
            copies = min(copies, int((left[inside] // counts[inside]).min()))
        if copies:
            plan.append((copies, counts))
            left -= copies * counts
    kinds: dict[bytes, list] = {}
    for counts in best_fit(left, capacity):
        kinds.setdefault(counts.tobytes(), [0, counts])[0] += 1
    return plan + [(n, counts) for n, counts in kinds.values()]


def plan_table(plan: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    """One line per (pattern, class): the class ranks it takes, its first sequence, items per copy and
    the slots before it. Sorted by (class, first rank) for binary search."""
    lines, first_rank, first_seq = [], {}, 0
    for copies, counts in plan:
        slot = 0
        for c in np.flatnonzero(counts)[::-1]:
            k, at = int(counts[c]), first_rank.get(int(c), 0)
            lines.append((int(c) + 1, at, first_seq, k, slot))
            first_rank[int(c)] = at + k * copies
            slot += k
        first_seq += copies
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    return dict(zip(("cls", "rank", "seq", "each", "slot"), table.T, strict=True)) | {"sequences": first_seq}


# --- the operator -------------------------------------------------------------------------------

def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   seq_len: int = SEQ_LEN, end_id: int = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of all documents, packed: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its tokens plus ``end_id``; null text counts as empty (one token), and every input
    row is a document, repeated rows too. Pieces of a sequence lie gapless from offset 0. An empty
    table gives no pieces; other columns are not read. Which of two equal-length pieces comes first is
    settled by (id, start, checksum), so a re-run task repeats its answer."""
    spark, capacity = docs.sparkSession, seq_len // quantum
    pieces = saved(token_pieces(docs, id_col, text_col, path, seq_len, end_id), "op8-pieces")
    full = pieces.filter(F.col("length") == seq_len)
    cls = F.ceil(F.col("length") / quantum).cast("int")
    rest = pieces.filter(F.col("length") < seq_len).withColumn("cls", cls)
    seen = rest.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    need = np.zeros(capacity, np.int64)
    for r in seen:
        need[r["cls"] - 1] = r["n"]
    table = plan_table(cutting_plan(need, capacity))

    # ranks within a class: a row number per (class, salt) plus the rows of smaller salts
    salts = max(1, -(-int(need.max(initial=0)) // ROWS_PER_SALT))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts).cast("long")))
    before = rest.groupBy("cls", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rest.withColumn("rn", F.row_number().over(
        Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")))
    before = before.select("cls", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = ranked.join(before, ["cls", "salt"]).withColumn("rank", F.col("rn") - 1 + F.col("before")).drop("rn", "before", "salt")

    plan = spark.createDataFrame(
        [tuple(map(int, line)) for line in zip(*(table[k] for k in ("cls", "rank", "seq", "each", "slot")), strict=True)],
        "cls int, first long, seq long, each long, slot long")
    lines = plan.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("first", "seq", "each", "slot"))).alias("lines"))
    # at most a few thousand lines whatever the corpus: classes times patterns per class
    line = F.element_at(F.filter("lines", lambda x: x["first"] <= F.col("rank")), -1)
    placed = (
        ranked.join(F.broadcast(lines), "cls").withColumn("l", line)
        .withColumn("k", F.col("rank") - F.col("l.first"))
        .withColumn("sequence_id", F.col("l.seq") + F.expr("k div l.each"))
        .withColumn("slot", F.col("l.slot") + F.expr("k % l.each")))
    by_slot = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(by_slot), F.lit(0)))

    # a full piece is a sequence of its own: numbered after the packed ones, again by salt
    parts = max(1, -(-full.count() // ROWS_PER_SALT))
    alone = full.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts).cast("long")))
    ahead = alone.groupBy("salt").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    alone = (
        alone.withColumn("rn", F.row_number().over(Window.partitionBy("salt").orderBy("doc_id", "start", "ids_crc32")))
        .join(ahead, "salt")
        .withColumn("sequence_id", F.lit(int(table["sequences"])).cast("long") + F.col("before") + F.col("rn") - 1)
        .withColumn("offset", F.lit(0).cast("long")))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*out).unionByName(alone.select(*out)).withColumnRenamed("doc_id", id_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
