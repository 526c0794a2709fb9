"""MinHash near-duplicates by a multi-index Hamming join (operator 11).

Two documents link when 100 * |intersection| >= 85 * |union| of their 3-word shingle sets.

* Signature. 96 min-hashes of a set, the low b = 8 bits of each. At similarity 0.85 a place differs with
  probability 0.15, so 14 of 96 are expected to, and more than ``RADIUS`` = 29 do for 5 links in 100 000.
* Multi-index. The 96 places are cut into 16 chunks of 6. By the pigeonhole principle a pair within the
  radius has two chunks or more with at most one error. A chunk's errors are enumerated on both sides, as
  its six values with one place blanked: two chunks with at most one error share such a key. So every
  pair within the radius meets in a list, whatever the data; lists of one class alone go.
* Long lists. First every member meets one centre of its list, the class that shares most keys; links
  merge components, and lists within one component are finished. A second turn takes centres from the
  other components.
* Around a centre. Members within the radius of a centre that it has no link with are often many (edited
  copies of one text), and so are the pairs among them. Their sets are known as what each lacks and
  has besides the centre's, so the overlaps of a whole block of pairs are two small matrix products, exact
  and without a pair ever becoming a row; only links that join components leave.
* Pairs still between components, without a common centre, are compared by signature within their list;
  a list of over ``BLOCK`` members is first cut by its members' second chunk (there is one, see above),
  and what is still longer goes by pairs of blocks. A pair leaves only the first of the lists it shares.
* Links are confirmed on the full sets, and distance alone never links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.bloom import bloom_words, in_bloom
from tickweave.llm.common import documents, map_arrow, per_process, saved, ship_package, text_chunks
from tickweave.llm.ngram_join import BLOOM_BITS, WordHashes, components, mixed, set_id

SHINGLE, NUM, DEN = 3, 17, 20  # similarity NUM / DEN
CHUNKS, CHUNK = 16, 6
PLACES = CHUNKS * CHUNK
RADIUS = 29  # two chunks have at most one error: 2 * (CHUNKS - 1) > RADIUS
BLOCK = 4096
ROUND_CENTRE = 1024  # members of a block around a centre
COLUMNS = 4096  # shingles min-hashed at a time


# --- sets and signatures --------------------------------------------------------------------------

ODD = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64), 5) | np.uint64(1)
SEEDS = (mixed(np.arange(PLACES, dtype=np.uint64), 21) >> np.uint64(32)).astype(np.uint32)[:, None]
FACTORS = (mixed(np.arange(PLACES, dtype=np.uint64), 22) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's 3-word shingles (words ASCII-lower-cased); with fewer words the
    whole sequence as one; none without words."""
    lines = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    hashes = per_process("minhash-words", WordHashes)
    h = np.fromiter((x for w in lines for x in map(hashes.__getitem__, w)), np.uint64, sum(map(len, lines)))
    whole = max(0, len(h) - SHINGLE + 1)
    windows = np.zeros(whole, np.uint64)
    for k in range(SHINGLE):
        windows += h[k:k + whole] * ODD[k]
    windows = mixed(windows)
    out, at = [], 0
    for w in lines:
        n = len(w)
        if n >= SHINGLE:
            s = np.sort(windows[at:at + n - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(mixed((h[at:at + n] * ODD[:n]).sum(dtype=np.uint64, keepdims=True), n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def signature(s: np.ndarray) -> bytes:
    """Eight bits of each of the set's min-hashes."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), COLUMNS):
        np.minimum(least, ((low[at:at + COLUMNS] ^ SEEDS) * FACTORS).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(both) - common) and common > 0


def _signed(batches):
    import pyarrow as pa
    for batch in batches:
        cls, sizes, sigs = [], [], []
        for _, part in text_chunks(batch.column("t").to_pylist()):
            for s in shingle_sets(part):
                cls.append(set_id(s))
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
            names=["id", "row", "cls", "n", "sig"])


# --- the index ------------------------------------------------------------------------------------

def sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, PLACES)


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, 96) keys: of each chunk, its values with one place blanked, under the number of that place."""
    chunks = sigs.reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    shifts = np.arange(CHUNK, dtype=np.int64) * 8
    parts = chunks << shifts
    keys = parts.sum(axis=2, keepdims=True) - parts
    return (keys | (np.arange(PLACES, dtype=np.int64).reshape(1, CHUNKS, CHUNK) << 48)).reshape(-1, PLACES)


def _keys(batches):
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            keys = chunk_keys(sig_matrix(batch.column("sig").to_pylist()))
            cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), PLACES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(cls)], names=["key", "cls"])


def _near(batches):
    """Pairs within the radius."""
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            far = (sig_matrix(batch.column("sx").to_pylist()) != sig_matrix(batch.column("sy").to_pylist())).sum(axis=1)
            yield batch.filter(pa.array(far <= RADIUS)).select(["x", "y", "cx", "cy"])


LIST_ROW = ["key", "sub", "cls", "comp", "n", "sig", "centres"]


def _second_lists(batches):
    """(key, sub, ...): members of a long list under each key of their other chunks; the others as they are."""
    import pyarrow as pa
    for batch in batches:
        long = batch.column("size").to_numpy(zero_copy_only=False) > BLOCK
        rest = batch.select(["key", "cls", "comp", "n", "sig", "centres"])
        plain = rest.filter(pa.array(~long))
        yield pa.RecordBatch.from_arrays([plain.column(0), pa.array(np.full(len(plain), -1)), *plain.columns[1:]],
                                         names=LIST_ROW)
        cut = rest.filter(pa.array(long))
        for at in range(0, len(cut), 4096):
            piece = cut.slice(at, 4096)
            subs = chunk_keys(sig_matrix(piece.column("sig").to_pylist()))
            own = (piece.column("key").to_numpy(zero_copy_only=False) >> 48) // CHUNK
            keep = (np.arange(PLACES)[None, :] // CHUNK) != own[:, None]
            rows = pa.array(np.nonzero(keep)[0])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), pa.array(subs[keep]), *(c.take(rows) for c in piece.columns[1:])],
                                             names=LIST_ROW)


def list_pairs(key: int, sub: int, one_block: bool, block: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, sigs: np.ndarray,
               centres: list[list[int]]):
    """(x, y) of a list's pairs between components, within the radius and without a common centre, that meet
    here first."""
    order = np.argsort(comp, kind="stable")
    block, cls, comp, n, sigs = block[order], cls[order], comp[order], n[order], sigs[order]
    numbers: dict[int, int] = {}
    for c in centres:
        for v in c or ():
            numbers.setdefault(v, len(numbers))
    around = np.zeros((len(cls), len(numbers)), bool)
    for row, k in enumerate(order):
        around[row, [numbers[v] for v in centres[k] or ()]] = True
    after = np.searchsorted(comp, comp, side="right")  # members of later components
    for i in range(len(cls)):
        j = np.arange(after[i], len(cls))
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[(DEN * small >= NUM * large) & (one_block | (block[j] != block[i]))]
        j = j[~around[j][:, around[i]].any(axis=1)]
        if not len(j):
            continue
        other = sigs[j] != sigs[i]
        near = other.sum(axis=1) <= RADIUS
        j, other = j[near], other[near].reshape(-1, CHUNKS, CHUNK)
        if not len(j):
            continue
        errors = other.sum(axis=2)
        shared = errors <= 1
        here = shared.copy()
        for at in (key, sub) if sub >= 0 else (key,):  # the first chunk shared, then the first of the others
            first = here.argmax(axis=1)
            rows = np.arange(len(j))
            place = np.where(errors[rows, first] == 0, 0, other[rows, first].argmax(axis=1))
            ok = first * CHUNK + place == at >> 48
            here[rows, first] = False
            j, other, errors, here = j[ok], other[ok], errors[ok], here[ok]
        for k in j:
            yield (cls[i], cls[k]) if cls[i] < cls[k] else (cls[k], cls[i])


def _list_pairs(batches):
    """Pairs of the lists of a stream sorted by list."""
    import pyarrow as pa

    def pairs(table):
        table = table.combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("key", "sub", "b1", "b2", "block", "cls", "comp", "n")}
        sigs, centres = sig_matrix(table.column("sig").to_pylist()), table.column("centres").to_pylist()
        group = np.flatnonzero(np.concatenate([[True], *[np.zeros(len(sigs) - 1, bool) | sum(col[c][1:] != col[c][:-1] for c in ("key", "sub", "b1", "b2")).astype(bool)]]))
        out = []
        for a, b in zip(group, np.append(group[1:], len(sigs)), strict=True):
            if b - a > 1:
                out += list_pairs(int(col["key"][a]), int(col["sub"][a]), col["b1"][a] == col["b2"][a],
                                  *(col[c][a:b] for c in ("block", "cls", "comp", "n")), sigs[a:b], centres[a:b])
        x, y = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)), pa.array(np.array(y, np.int64))], names=["x", "y"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(c)[-1].as_py() for c in ("key", "sub", "b1", "b2")] if len(held) else None
        if last is None:
            continue
        same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "sub", "b1", "b2"), last, strict=True)])
        cut = int(np.argmax(same))  # the last list may go on in the next batch
        if cut:
            yield pairs(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and len(held):
        yield pairs(held)


# --- links ----------------------------------------------------------------------------------------

def _class_sets(batches):
    """(cls, set) of texts that have the class they were fetched for."""
    import pyarrow as pa
    for batch in batches:
        wanted = batch.column("cls").to_pylist()
        for start, part in text_chunks(batch.column("t").to_pylist(), 1 << 19):
            found = [(c, s.tobytes()) for c, s in zip(wanted[start:], shingle_sets(part)) if set_id(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())],
                                             names=["cls", "words"])


def _confirmed(batches):
    """Whether pairs are linked, and what either set has that the other lacks."""
    import pyarrow as pa
    for batch in batches:
        ok, only_x, only_y = [], [], []
        for a, b in zip(batch.column("wx"), batch.column("wy"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            ok.append(linked(x, y))
            if batch.num_columns == 5:
                continue
            only_x.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
            only_y.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
        rest = [] if batch.num_columns == 5 else [pa.array(only_x, pa.binary()), pa.array(only_y, pa.binary()), batch.column("cx"), batch.column("cy")]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(ok, pa.bool_()), *rest],
                                         names=["x", "y", "ok", *["only_x", "only_y", "cx", "cy"][:len(rest)]])


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices, some columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets) if len(rows) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # elements of one set alone meet nothing but themselves
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[at]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(shared), columns):
        here = (at >= start) & (at < start + columns)
        block = np.zeros((len(sets), min(columns, len(shared) - start)), np.float32)
        block[rows[here], at[here] - start] = 1
        out += block @ block.T
    return out


def _around(table):
    """Links between components among the members of a block (or two) around one centre, no more than join
    them; every set is the centre's without ``minus`` and with ``plus``."""
    import pyarrow as pa
    table = table.combine_chunks().sort_by("cls")
    cls, comp, n, own = (table.column(c).to_numpy() for c in ("cls", "comp", "n", "own"))
    minus, plus = ([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column(c)] for c in ("minus", "plus"))
    lacks, has = np.array([len(m) for m in minus]), np.array([len(p) for p in plus])
    whole = n + lacks - has  # the centre's size, for every row
    both = whole[:, None] - lacks[:, None] - lacks[None, :] + common(minus) + common(plus)
    link = (DEN * both >= NUM * (n[:, None] + n[None, :] - both)) & (both > 0) & (comp[:, None] != comp[None, :])
    if table.column("o")[0].as_py() != table.column("m")[0].as_py():
        link &= own[:, None] != own[None, :]
    root, x, y = comp.copy(), [], []
    for i in np.flatnonzero(link.any(axis=1)):
        for j in np.flatnonzero(link[i]):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                x.append(min(cls[i], cls[j]))
                y.append(max(cls[i], cls[j]))
    return pa.table({"x": np.array(x, np.int64), "y": np.array(y, np.int64)})


class Links:
    """Tested pairs of classes and the components that their links make."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes
        self.sets = self.tested = self.comp = None
        self.edges = self.stars = None  # links; pairs with a centre and their differences

    def labelled(self, post: DataFrame) -> DataFrame:
        """``post`` with each class's component; only lists that hold more than one."""
        post = post.drop("comp")
        post = (post.withColumn("comp", F.col("cls")) if self.comp is None else
                post.join(self.comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
        post = saved(post, "op11-lists")
        several = post.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("size")).filter("a != b")
        return saved(post.join(several.select("key", "size"), "key"), "op11-lists")

    def test(self, pairs: DataFrame, stars: bool) -> None:
        """Confirm distinct pairs x < y on their full sets: of centres (``stars``, with the marks cx, cy of the
        side that is one), or within the radius."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["x", "y"], "left_anti")
        if stars:
            sig = lambda c: self.classes.select(F.col("cls").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
            fits = F.least("nx", "ny") * DEN >= F.greatest("nx", "ny") * NUM
            met = pairs.join(sig("x"), "x").join(sig("y"), "y").filter(fits)
            pairs = map_arrow(met.select("x", "y", "cx", "cy", "sx", "sy"), _near, "x long, y long, cx boolean, cy boolean")
        pairs = saved(pairs, "op11-pairs")
        if pairs.isEmpty():
            return
        needed = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
        if self.sets is not None:
            needed = needed.join(self.sets, "cls", "left_anti")
        needed = saved(self.classes.join(needed, "cls", "left_semi").select("cls", "row"), "op11-needed")
        words = bloom_words(needed.select(F.col("row").alias("key")), 1, 2, BLOOM_BITS)
        texts = self.rows.filter(in_bloom(F.col("row"), words, 1, 2, BLOOM_BITS)).select("row", "t").join(needed, "row")
        sets = saved(map_arrow(texts.select("cls", "t"), _class_sets, "cls long, words binary").dropDuplicates(["cls"]), "op11-sets")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        both = (pairs.join(self.sets.select(F.col("cls").alias("x"), F.col("words").alias("wx")), "x")
                .join(self.sets.select(F.col("cls").alias("y"), F.col("words").alias("wy")), "y"))
        if not stars:
            both = both.select("x", "y", "wx", "wy", F.lit(0).alias("plain"))
            found = saved(map_arrow(both, _confirmed, "x long, y long, ok boolean"), "op11-tested")
        else:
            found = saved(map_arrow(both.select("x", "y", "wx", "wy", "cx", "cy"), _confirmed,
                                    "x long, y long, ok boolean, only_x binary, only_y binary, cx boolean, cy boolean"), "op11-tested")
            self.stars = found if self.stars is None else self.stars.unionByName(found)
        found = found.select("x", "y", "ok")
        self.tested = found if self.tested is None else self.tested.unionByName(found)
        self.join(found.filter("ok").select("x", "y"))

    def join(self, links: DataFrame) -> None:
        """Add links (a saved table) and merge components."""
        if not links.isEmpty():
            self.edges = links if self.edges is None else self.edges.unionByName(links)
            self.comp = components(self.edges)

    def around_centres(self) -> DataFrame:
        """Add the links among the members of every centre that has members of several components; (cls,
        centres): where they were looked for."""
        if self.stars is None:
            return self.classes.select("cls", F.array("cls").alias("centres")).limit(0)
        side = lambda c, cls, minus, plus: self.stars.filter(f"c{c}").select(F.col(c).alias("centre"), F.col(cls).alias("cls"), F.col(minus).alias("minus"), F.col(plus).alias("plus"))
        rows = side("x", "y", "only_x", "only_y").unionByName(side("y", "x", "only_y", "only_x"))
        comp = self.comp if self.comp is not None else self.classes.select("cls", F.col("cls").alias("comp")).limit(0)
        main = comp.select(F.col("cls").alias("centre"), F.col("comp").alias("main"))
        rows = rows.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(main, "centre", "left") \
            .withColumn("main", F.coalesce("main", "centre")).join(self.classes.select("cls", "n"), "cls")
        rows = saved(rows.withColumn("home", F.col("comp") == F.col("main")), "op11-around")
        blocks = rows.groupBy("centre").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.ceil(F.sum(F.col("home").cast("long")) / ROUND_CENTRE).alias("mains"),
                                            F.ceil(F.sum((~F.col("home")).cast("long")) / ROUND_CENTRE).alias("others")).filter("a != b AND others > 0")
        rows = rows.join(blocks.select("centre", "mains", "others"), "centre")
        own = F.when(F.col("home"), -1 - F.pmod(F.xxhash64("cls"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("cls"), F.col("others")))
        rows = rows.withColumn("own", own)
        each = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
        place = lambda o, m: F.struct(o.alias("o"), m.alias("m"))
        at = F.when(F.col("home"), F.transform(each(F.col("others")), lambda o: place(o, F.col("own")))).otherwise(F.concat(
            F.transform(each(F.col("mains")), lambda m: place(F.col("own"), -1 - m)),
            F.transform(each(F.col("others")), lambda o: place(F.least("own", o), F.greatest("own", o)))))
        dealt = rows.withColumn("at", F.explode(at)).select("centre", "at.o", "at.m", "own", "cls", "comp", "n", "minus", "plus")
        ship_package(rows.sparkSession)
        self.join(saved(dealt.groupBy("centre", "o", "m").applyInArrow(_around, "x long, y long"), "op11-around-links"))
        return rows.groupBy("cls").agg(F.collect_set("centre").alias("centres"))  # a class has two centres a key at most


def star(post: DataFrame, centre: DataFrame) -> DataFrame:
    """Distinct (x, y, cx, cy), x < y, of every list's members with its centre, other components only."""
    met = post.join(centre, "key").filter(F.col("comp") != F.col("c.comp"))
    first = F.col("c.cls") < F.col("cls")
    return met.select(F.least("cls", "c.cls").alias("x"), F.greatest("cls", "c.cls").alias("y"), first.alias("cx")) \
        .groupBy("x", "y").agg(F.max("cx").alias("cx"), F.max(~F.col("cx")).alias("cy"))


def remaining_pairs(post: DataFrame, classes: DataFrame, centres: DataFrame) -> DataFrame:
    """(x, y) within the radius, of different components and without a common centre, that share a list."""
    rows = post.join(classes.select("cls", "n", "sig"), "cls").join(centres, "cls", "left").select("key", "size", "cls", "comp", "n", "sig", "centres")
    rows = map_arrow(rows, _second_lists, "key long, sub long, cls long, comp long, n long, sig binary, centres array<long>")
    rows = saved(rows, "op11-cut")
    blocks = rows.groupBy("key", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = rows.join(blocks.drop("size"), ["key", "sub"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "sub", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"), "block", "cls", "comp", "n", "sig", "centres")
    by = ["key", "sub", "b1", "b2"]
    return map_arrow(dealt.repartition(*by).sortWithinPartitions(*by), _list_pairs, "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row: the size of the shingle set, the least id
    reachable by links, itself included, and whether it is that one.

    Null and empty texts have no shingles and link with nothing; repeated rows and equal sets link at once
    (all rows with the least id are kept); a null id is reached but never the least, a group of null ids
    alone has a null component and is kept. Texts of any length are taken whole. An empty table gives no
    rows; other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.select("id", F.xxhash64(F.col("id").cast("string"), "t").alias("row"), "t")
    signed = saved(map_arrow(rows, _signed, f"id {dict(rows.dtypes)['id']}, row long, cls long, n long, sig binary"), "op11-signed")
    members = signed.select("id", "cls", "n")
    classes = saved(signed.filter("n > 0").groupBy("cls").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("sig").alias("sig")), "op11-classes")
    keys = map_arrow(classes.select("cls", "sig"), _keys, "key long, cls long")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    post = saved(keys.join(often, "key"), "op11-postings")
    score = post.groupBy("cls").agg(F.sum("m").alias("score"))
    post = saved(post.drop("m").join(score, "cls"), "op11-scored")

    links = Links(rows, classes)
    best = F.max(F.struct("score", "cls", "comp")).alias("c")
    at = links.labelled(post)
    links.test(star(at, at.groupBy("key").agg(best)), stars=True)
    at = links.labelled(at.select("key", "cls", "score"))
    first = at.groupBy("key").agg(best).select("key", F.col("c.comp").alias("main"))
    links.test(star(at, at.join(first, "key").filter("comp != main").groupBy("key").agg(best)), stars=True)
    centres = links.around_centres()
    at = links.labelled(at.select("key", "cls", "score"))
    links.test(remaining_pairs(at, classes, centres), stars=False)

    some = members.filter("n > 0")
    if links.comp is not None:
        some = some.join(links.comp, "cls", "left").withColumn("cls", F.coalesce("comp", "cls"))
    least = some.groupBy("cls").agg(F.min("id").alias("component_id"))
    out = some.join(least, "cls").select("id", F.col("n").alias("n_shingles"), "component_id")
    none = members.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
sh AS (SELECT r, unnest(s) AS x, len(s) AS n FROM sets),
edges AS (
  SELECT a.r AS x, b.r AS y FROM sh a JOIN sh b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS o FROM sets UNION SELECT reach.r, e.y FROM reach JOIN edges e ON e.x = reach.o)
SELECT s.doc_id, len(s.s) AS n_shingles, min(t.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(t.doc_id) AS kept
FROM sets s JOIN reach ON reach.r = s.r JOIN sets t ON t.r = reach.o GROUP BY s.r, s.doc_id, s.s
"""
