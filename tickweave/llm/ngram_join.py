"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 5).

Two documents link when 100 * |intersection| >= 75 * |union| of their 5-word shingle sets; the result is
each document's component under links. The join is exact (up to 64-bit hashing of shingles).

* Classes. Documents with the same set are one class, linked at once; only classes go on.
* Prefixes. In one global order of shingles, two linked sets of sizes n share at least l shingles
  among their first ``n - ceil(0.75 n) + l``, for every l >= 1. The order puts costly (frequent)
  shingles last. Each class picks its own l: the prefix whose estimated cost - postings it adds plus
  candidates it lets through, a candidate needing l matches - is least. Classes with only rare
  shingles take l = 1; classes made of common passages take longer prefixes and demand more matches.
* Frequent shingles come from lossy counting over all documents: every block reports shingles found
  twice or more, the reports are summed, the most frequent are known to all tasks (a fixed number).
  They only shape the order, never the result, so the bound drops nothing.
* Postings are dealt by shingle; shingles of one class alone vanish there. Very frequent ones are dealt
  by class instead, so a shingle of a third of all documents is spread over all tasks.
* Candidates. Instead of all pairs of a posting list, rounds of centres: every member of a long list is
  tested against one centre of the list it is not yet connected with, links merge components, and lists within one
  component are finished. When the pairs left between components are few, they are all counted: a pair
  whose prefixes share too few shingles for the needed overlap cannot link and is left out.
* Marks. Every set has a bit map of about four bits a shingle: bits that only one of two sets has are shingles that only it
  has, so they bound the overlap from above. Pairs whose bound is too small cannot link; no text travels for them.
* Verification compares the two whole texts' sets; a text travels to its row key and to its centre, once a pair.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.bloom import bloom_words, in_bloom
from tickweave.llm.common import documents, free_name, map_arrow, per_process, saved, ship_package, text_chunks

SHINGLE, NUM, DEN = 5, 3, 4  # similarity NUM / DEN
BLOCK_TOKENS = 1_000_000
KNOWN_FREQUENT = 1 << 18
PART_POSTINGS = 500_000
MIN_PARTS = 64
MOST_MATCHES = 8
VERIFY_COST = 2.0  # of a candidate, in postings
MOST_MARKS = 1 << 14  # bits of a set's map; longer sets are told apart less well, which costs time only
GROUP_PAIRS = 256  # pairs of one centre that a group of the verification holds
BLOOM_BITS = 1 << 24
SPREAD_FROM = 256  # counted at least so often, a shingle's list is dealt by class
LONG_LIST, FEW_PAIRS, MOST_ROUNDS = 64, 2.0, 2  # members; pairs left per posting; turns of centres
FAR_PLACE = 255  # a shingle's place in the order of its set; this one stands for all from here on
LOW48 = np.uint64((1 << 48) - 1)


# --- sets ---------------------------------------------------------------------------------------

class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift) over an array."""
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


#: Odd multipliers of a shingle's five places.
PLACES = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: 5-word windows of ASCII-lower-cased words; with fewer
    words the whole sequence as one; none without words."""
    lines = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    lengths = [len(w) for w in lines]
    hashes = per_process("shingle-words", WordHashes)
    h = np.fromiter((x for w in lines for x in map(hashes.__getitem__, w)), np.uint64, sum(lengths))
    whole = max(0, len(h) - SHINGLE + 1)
    windows = np.zeros(whole, np.uint64)
    for k in range(SHINGLE):
        windows += h[k:k + whole] * PLACES[k]
    windows = mixed(windows)
    out, at = [], 0
    for n in lengths:
        if n >= SHINGLE:
            s = np.sort(windows[at:at + n - SHINGLE + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else np.concatenate([s[:1], s[1:][new]]))
        elif n:
            out.append(mixed((h[at:at + n] * PLACES[:n]).sum(dtype=np.uint64, keepdims=True), n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit id of a whole set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def least_overlap(n: int) -> int:
    """Shingles that any linked partner must share with a set of n."""
    return -(-NUM * n // DEN)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both) and both > 0


def marks(s: np.ndarray) -> bytes:
    """The bit map of a set: a power of two bits, four or more a shingle up to ``MOST_MARKS``."""
    size = min(MOST_MARKS, max(64, 1 << (DEN * len(s) - 1).bit_length())) if len(s) else 0
    bits = np.zeros(size, bool)
    if size:
        bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Whether sets of ``na`` and ``nb`` shingles with these bit maps can share enough to link."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # the larger map is folded: a bit's place is the hash modulo the size
        half = max(len(x), len(y)) // 2
        x, y = (v[:half] | v[half:] if len(v) > half else v for v in (x, y))
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return (NUM + DEN) * most >= NUM * (na + nb)


def each_set(batches, text_at: int):
    """(batch, row, set) over Arrow batches."""
    for batch in batches:
        for start, part in text_chunks(batch.column(text_at)):
            for i, s in enumerate(shingle_sets(part)):
                yield batch, start + i, s


SETS = "k long, kind int, cls long, n long, marks binary"


def set_rows(rows: DataFrame) -> DataFrame:
    """kind 0: (id, k, cls, n, marks) of every row; kind 1: (shingle, count) found twice or more in a block."""

    def run(batches):
        import pyarrow as pa
        held, size, seen = [], 0, set()

        def report(kind):
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            values, counts = values[often].astype(np.int64), counts[often]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(values), kind), pa.nulls(len(values), pa.int64()), pa.array(np.ones(len(values), np.int32)),
                 pa.array(values), pa.array(counts.astype(np.int64)), pa.nulls(len(values), pa.binary())],
                ["id", "k", "kind", "cls", "n", "marks"])

        kind = None
        for batch in batches:
            kind, cls, sizes, maps = batch.schema.field(0).type, [], [], []
            for start, part in text_chunks(batch.column(1)):
                for s in shingle_sets(part):
                    c = set_id(s)
                    cls.append(c)
                    sizes.append(len(s))
                    maps.append(marks(s))
                    if len(s) and c not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                if size > BLOCK_TOKENS:
                    yield report(kind)
                    held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.zeros(len(cls), np.int32)), pa.array(cls, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["id", "k", "kind", "cls", "n", "marks"])
        if held:
            yield report(kind)

    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, {SETS}")


# --- prefixes and postings ----------------------------------------------------------------------

class Frequent:
    """The known frequent shingles: sorted values and their counts."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts

    def count(self, s: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.ones(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        return np.where(self.values[at] == s, self.counts[at], 1)


def adaptive_prefix(s: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix shingles in order, whether the list of each is to be spread, l) of a set. Order: unknown shingles by hash,
    then known ones by count, then hash - the same order for all sets."""
    n = len(s)
    short = n - least_overlap(n)
    df = frequent.count(s)
    hot = df > 1
    if not hot.any():
        return s[:short + 1], df[:short + 1] >= SPREAD_FROM, 1
    known = np.flatnonzero(hot)
    known = known[np.lexsort((s[known], df[known]))]
    order = np.concatenate([np.flatnonzero(~hot), known])
    df = df[order]
    l = 1
    if df[short] > 1:
        most = min(MOST_MATCHES, n - short)
        reach = np.cumsum(df)[short:short + most].astype(float)  # postings met by the prefix of each l
        ls = np.arange(1, most + 1)
        l = int((reach + VERIFY_COST * (reach - short - ls) / ls).argmin()) + 1
    keep = order[:short + l]
    return s[keep], df[:short + l] >= SPREAD_FROM, l


def postings(rows: DataFrame, frequent: Frequent, parts: int) -> DataFrame:
    """(token, cls, l, place, ...): prefix postings of every class, shingles met by one class only left out.

    Copies share most of their shingles, so many lists are equal (the same members): a list has a
    signature, which takes the shingle's place, and equal lists of a part are one, ``times`` over
    (:func:`distinct_lists`).

    A token is a shingle's low 48 bits and its part; two shingles that agree in those make at most an
    extra candidate. Postings travel as byte strings, one per task, part and block."""
    values, counts = frequent.values, frequent.counts

    def deal(batches):
        import pyarrow as pa
        known, seen, held, size = Frequent(values, counts), set(), [], 0

        def blocks():
            token = np.concatenate([t for t, _, _, _ in held])
            hot = np.concatenate([f for _, f, _, _ in held])
            cls = np.repeat(np.array([c for _, _, c, _ in held], np.int64), [len(t) for t, _, _, _ in held])
            ls = np.concatenate([x for _, _, _, x in held])
            pos = np.concatenate([np.minimum(np.arange(len(t)), FAR_PLACE).astype(np.uint8) for t, _, _, _ in held])
            home = (mixed(token, 7) % np.uint64(parts)).astype(np.int64)
            token = (token & LOW48) | (home.astype(np.uint64) << np.uint64(48))
            spread = (mixed(cls.view(np.uint64), 11) % np.uint64(parts)).astype(np.int64)
            part = np.where(hot, parts + spread, home)
            order = np.argsort(part, kind="stable")
            part, token, cls, ls, pos = part[order], token[order], cls[order], ls[order], pos[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(cuts[1:], len(part))
            low = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]),
                 pa.array([cls[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]),
                 pa.array([ls[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]),
                 pa.array([pos[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]),
                 pa.array([(int(token[a]) >> 48) if p < parts else -1 for a, p in zip(cuts, part[cuts], strict=True)], pa.int32()),
                 pa.array([b"" if p < parts else (token[a:b] >> np.uint64(48)).astype("<u2").tobytes()
                           for a, b, p in zip(cuts, ends, part[cuts], strict=True)])],
                ["part", "low", "cls", "l", "place", "home", "homes"])

        for _, _, s in each_set(batches, 1):
            if not len(s):
                continue
            c = set_id(s)
            if c in seen:
                continue
            seen.add(c)
            token, hot, l = adaptive_prefix(s, known)
            held.append((token, hot, c, np.full(len(token), l, np.uint8)))
            size += len(token)
            if size > BLOCK_TOKENS // 2:
                yield blocks()
                held, size = [], 0
        if held:
            yield blocks()

    def gather(table):
        import pyarrow as pa
        token, cls, ls, pos = [], [], [], []
        hot = False
        for row in zip(*(table.column(c).to_pylist() for c in ("low", "cls", "l", "place", "home", "homes")), strict=True):
            low, c, x, places, home, homes = row
            n = len(x)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(low, np.uint8).reshape(n, 6)
            t = wide.reshape(-1).view("<u8").astype(np.uint64)
            top = np.full(n, home, np.uint64) if home >= 0 else np.frombuffer(homes, "<u2").astype(np.uint64)
            hot = home < 0
            token.append(t | (top << np.uint64(48)))
            cls.append(np.frombuffer(c, np.int64))
            ls.append(np.frombuffer(x, np.uint8))
            pos.append(np.frombuffer(places, np.uint8))
        token, cls, ls, pos = (np.concatenate(v) for v in (token, cls, ls, pos))
        order = np.lexsort((cls, token))
        token, cls, ls, pos = token[order], cls[order], ls[order], pos[order]
        new_token = np.concatenate([[True], token[1:] != token[:-1]])
        keep = new_token | np.concatenate([[True], cls[1:] != cls[:-1]])  # a class once per shingle
        token, cls, ls, pos = token[keep], cls[keep], ls[keep], pos[keep]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(starts, len(token)))
        if hot:  # a part holds some members of each list: lists stay as they are
            times = np.ones(len(token), np.int64)
        else:  # equal lists become one, a member's place in it the first of its places
            word = mixed(cls.view(np.uint64), 3)
            of = mixed(np.add.reduceat(word, starts) + count.astype(np.uint64))  # one value per list
            keep = np.repeat(count > 1, count)
            token, cls, ls, pos = np.repeat(of, count)[keep], cls[keep], ls[keep], pos[keep]
            order = np.lexsort((cls, token))
            token, cls, ls, pos = token[order], cls[order], ls[order], pos[order]
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])[:len(token)]
            starts = np.flatnonzero(first)
            times = np.diff(np.append(starts, len(token)))
            pos = np.minimum.reduceat(pos, starts) if len(starts) else pos
            token, cls, ls = token[starts], cls[starts], ls[starts]
        return pa.table({"token": token.astype(np.int64), "cls": cls, "l": ls.astype(np.int32),
                         "place": pos.astype(np.int32), "times": times})

    ship_package(rows.sparkSession)
    dealt = map_arrow(rows, deal, "part int, low binary, cls binary, l binary, place binary, home int, homes binary")
    return dealt.groupBy("part").applyInArrow(gather, "token long, cls long, l int, place int, times long")


def distinct_lists(post: DataFrame) -> DataFrame:
    """(token, cls, l, place, w): equal lists of all parts as one, standing for w shingles. Lists that
    are spread over parts go by their shingle and stay as they are."""
    return post.groupBy("token", "cls").agg(
        F.min("l").alias("l"), F.min("place").alias("place"), F.sum("times").alias("w"))


# --- candidates, verification, components -------------------------------------------------------

def near_pairs(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """(x, y, c) of the pairs (x, y, c, nx, ny) that their marks let link."""

    def check(batches):
        import pyarrow as pa
        for batch in batches:
            ok = [may_link(*p) for p in zip(*(batch.column(k).to_pylist() for k in (5, 6, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)], ["x", "y", "c"]).filter(pa.array(ok, pa.bool_()))

    both = (pairs.join(one.select(F.col("cls").alias("x"), F.col("marks").alias("mx")), "x")
            .join(one.select(F.col("cls").alias("y"), F.col("marks").alias("my")), "y"))
    return map_arrow(both.select("x", "y", "c", "nx", "ny", "mx", "my"), check, "x long, y long, c long")


def verified(pairs: DataFrame, rows: DataFrame, one: DataFrame) -> DataFrame:
    """(x, y, ok) of distinct class pairs (x, y, c: the one of both that is the centre), by their texts.

    The pairs of a centre are dealt into groups of about ``GROUP_PAIRS``; a group gets the text of its centre once
    and that of each partner once, sorted so that the centre comes first, and holds one set and one batch. One row
    stands for a class (its row key in ``one``); the scan keeps those rows by a Bloom filter of fixed size."""

    def check(batches):
        import pyarrow as pa
        group = last = centre = None
        for batch in batches:
            c, g, cls = (batch.column(k).to_pylist() for k in range(3))
            x, y, ok = [], [], []
            for start, part in text_chunks(batch.column(3)):
                for i, s in enumerate(shingle_sets(part), start):
                    if (c[i], g[i]) != group:
                        group, last = (c[i], g[i]), None
                    if cls[i] == last:  # a repeated row
                        continue
                    last = cls[i]
                    if last == c[i]:
                        centre = s
                        continue
                    x.append(min(last, c[i]))
                    y.append(max(last, c[i]))
                    ok.append(linked(centre, s))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(ok, pa.bool_())], ["x", "y", "ok"])

    many = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > GROUP_PAIRS)
    dealt = pairs.join(many, "c", "left").select(
        "c", F.coalesce(F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("k") / GROUP_PAIRS)), F.lit(0)).alias("g"),
        F.when(F.col("c") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("cls"))
    asked = saved(dealt, "op5-asked")
    asked = asked.unionByName(asked.select("c", "g", F.col("c").alias("cls")).distinct())
    asked = asked.join(one.select("cls", "k"), "cls")
    words = bloom_words(asked.select(F.col("k").alias("key")), 1, 2, BLOOM_BITS)
    texts = rows.filter(in_bloom(F.col("k"), words, 1, 2, BLOOM_BITS)).select("k", "t").join(asked, "k")
    groups = texts.select("c", "g", "cls", "t").repartition("c", "g").sortWithinPartitions("c", "g", F.col("cls") != F.col("c"), "cls")
    return map_arrow(groups, check, "x long, y long, ok boolean")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): the least class of each component of ``edges`` (x, y), by least neighbour labels and
    label jumping; each turn is a saved table, so lineage stays short."""
    both = saved(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "op5-edges")
    label = saved(both.groupBy(F.col("x").alias("cls")).agg(F.least(F.min("y"), F.col("cls")).alias("comp")), "op5-label")
    while True:
        near = (both.join(label.select(F.col("cls").alias("y"), F.col("comp").alias("other")), "y")
                .groupBy(F.col("x").alias("cls")).agg(F.min("other").alias("other")))
        step = label.join(near, "cls").select("cls", "comp", F.least("comp", "other").alias("next"))
        jump = step.select(F.col("cls").alias("next"), F.col("next").alias("far"))
        turn = saved(step.join(jump, "next").select("cls", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")), "op5-label")
        label = turn.select("cls", "comp")
        if turn.filter("moved").isEmpty():
            return label


def shared_pairs(at: DataFrame) -> DataFrame:
    """(x, y) of different components that share enough prefix shingles to link, x the smaller set.

    With a needed overlap o, the first l common shingles of a linked pair lie among the first n - o + l of
    either set, and l is the lesser of the two classes' (its prefix is at least as long, since o is 0.75 n
    or more). So only shingles at such places are joined, and l of them are asked for. A list that stands
    for several counts each of them when its first lies there: m is never too small."""
    x = at.select("token", F.col("cls").alias("x"), F.col("l").alias("lx"), F.col("place").alias("px"), F.col("comp").alias("cx"), F.col("n").alias("nx"), "w")
    y = at.select("token", F.col("cls").alias("y"), F.col("l").alias("ly"), F.col("place").alias("py"), F.col("comp").alias("cy"), F.col("n").alias("ny"))
    first = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    fits = (F.col("nx") * DEN >= F.col("ny") * NUM) & (F.col("cx") != F.col("cy"))
    room = F.least("lx", "ly") - F.ceil((F.col("nx") + F.col("ny")) * NUM / (NUM + DEN))
    early = [(F.col(p) >= FAR_PLACE) | (F.col(p) < F.col(n) + room) for p, n in (("px", "nx"), ("py", "ny"))]
    joined = x.join(y, (x["token"] == y["token"]) & first & fits & early[0] & early[1])
    met = joined.groupBy("x", "y", "lx", "ly").agg(F.sum("w").alias("m"))
    return met.filter(F.col("m") >= F.least("lx", "ly")).select("x", "y")


def class_links(rows: DataFrame, post: DataFrame, members: DataFrame) -> DataFrame | None:
    """(cls, comp) of every class with a link; None when no two classes share a prefix shingle.

    Turns of centres go over the long lists only, while the pairs left in those are many; the last turn
    takes the short lists and the long ones that still hold more than one component."""
    at = saved(distinct_lists(post).withColumn("comp", F.col("cls")), "op5-lists")
    n_post = post.count()
    if not n_post:
        return None
    sizes = saved(members.select("cls", "n").distinct().join(at.select("cls").distinct(), "cls", "left_semi"), "op5-sizes")
    nx = sizes.select(F.col("cls").alias("x"), F.col("n").alias("nx"))
    ny = sizes.select(F.col("cls").alias("y"), F.col("n").alias("ny"))
    fits = DEN * F.least("nx", "ny") >= NUM * F.greatest("nx", "ny")
    tested, comp = None, None

    def labelled(lists: DataFrame) -> DataFrame:
        return lists if comp is None else lists.drop("comp").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def open_lists(lists: DataFrame) -> DataFrame:
        """(token, a, left): members and pairs left of the lists that hold more than one component."""
        per = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("s")).groupBy("token").agg(
            F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("b")).filter("a * a > b")
        return per.select("token", "a", ((F.col("a") * F.col("a") - F.col("b")) / 2).alias("left"))

    def test(pairs: DataFrame) -> None:
        """Test the pairs (x, c: the centre) that were not tested yet, and label the components anew."""
        nonlocal tested, comp
        pairs = pairs.groupBy(F.least("x", "c").alias("x"), F.greatest("x", "c").alias("y")).agg(F.min("c").alias("c"))
        pairs = pairs.join(nx, "x").join(ny, "y").filter(fits)
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = saved(pairs, "op5-met")
        asked = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
        one = saved(members.join(asked, "cls", "left_semi").groupBy("cls").agg(F.min("k").alias("k"), F.first("marks").alias("marks")), "op5-rows")
        found = saved(verified(saved(near_pairs(pairs, one), "op5-pairs"), rows, one), "op5-tested")
        tested = found if tested is None else tested.unionByName(found)
        if not found.filter("ok").isEmpty():
            comp = components(tested.filter("ok"))

    long_tokens = at.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG_LIST).select("token")
    there = saved(at.join(long_tokens, "token", "left_semi"), "op5-long")
    for turn in range(MOST_ROUNDS):
        if comp is not None:
            there = saved(labelled(there), "op5-long")
        lists = saved(open_lists(there), "op5-open")
        if (lists.agg(F.sum("left")).first()[0] or 0.0) <= FEW_PAIRS * n_post:
            break
        there = saved(there.join(lists.select("token"), "token", "left_semi"), "op5-long")
        # the first turn takes one centre for all lists that agree on it, later ones differ by list
        rank = F.xxhash64("cls", F.lit(turn)) if turn == 0 else F.xxhash64("cls", "token", F.lit(turn))
        # a centre has the fewest rarer shingles, as the text has that edited copies come from
        centre = there.groupBy("token").agg(F.min(F.struct("place", rank.alias("r"), "cls", "comp")).alias("c"))
        test(there.join(centre, "token").filter(F.col("comp") != F.col("c.comp")).select(
            F.col("cls").alias("x"), F.col("c.cls").alias("c")))
    at = at.join(long_tokens, "token", "left_anti").unionByName(there.select(at.columns))
    at = saved(labelled(at), "op5-lists")
    at = at.join(open_lists(at).select("token"), "token", "left_semi")
    test(shared_pairs(at.join(sizes, "cls")).withColumnRenamed("y", "c"))
    return comp


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per input row: the size of the shingle set and the least
    id reachable by links, itself included.

    Null and empty texts have no shingles and link with nothing (component_id is their own id); repeated
    rows and equal texts link at once; a null id is reached but never the least. Empty input gives no
    rows; other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.withColumn("k", F.xxhash64("id", "t"))  # the row, where a class is asked for by one of its rows
    sets = saved(set_rows(rows), "op5-sets")
    members = sets.filter("kind = 0").select("id", "k", "cls", "n", "marks")
    often = (sets.filter("kind = 1").groupBy(F.col("cls").alias("v")).agg(F.sum("n").alias("c"))
             .orderBy(F.desc("c"), "v").limit(KNOWN_FREQUENT).toPandas())  # a fixed number of rows
    values = often["v"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    frequent = Frequent(values[order], often["c"].to_numpy(np.int64)[order])
    total = members.agg(F.sum(F.floor(F.col("n") / DEN) + 1)).first()[0] or 0
    parts = min(1 << 15, max(MIN_PARTS, -(-int(total) // PART_POSTINGS)))
    post = saved(postings(rows.select("id", "t"), frequent, parts), "op5-postings")
    comp = class_links(rows, post, members)
    some = members.filter("n > 0")
    least = some.groupBy("cls").agg(F.min("id").alias("component_id"))
    if comp is not None:
        classes = saved(least.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "op5-classes")
        whole = classes.groupBy("comp").agg(F.min("component_id").alias("component_id"))
        least = classes.select("cls", "comp").join(whole, "comp").select("cls", "component_id")
    out = some.join(least, "cls").select("id", F.col("n").alias("n_shingles"), "component_id")
    none = members.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one document of each component: the one with the least id. A document
    is its id and text: repeated rows of one are one, but an id's other texts go only by their own links.
    Documents without words and rows with a null id all stay."""
    known, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    row = F.when(known.isNotNull(), F.struct(known.alias("i"), F.xxhash64(text).alias("h")))  # least id, then hash
    groups = saved(jaccard_components(docs.select(row.alias("row"), text.alias("t")), "row", "t").filter("n_shingles > 0"), "op5-groups")
    mark = free_name(docs.columns, "_row")
    drop = groups.filter("row != component_id").select(F.col("row").alias(mark)).distinct()
    rows = docs.join(drop, row == F.col(mark), "left_anti")
    twice = groups.filter("row IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("row").alias(mark))
    if twice.isEmpty():
        return rows
    return rows.join(twice, row == F.col(mark), "left_anti").unionByName(
        rows.join(twice, row == F.col(mark), "left_semi").dropDuplicates([id_col, text_col]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
