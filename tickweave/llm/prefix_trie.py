"""Prefix trie of conversations by adaptive radix trees (operator 12).

A turn is a fixed-width id (16 bytes, a digest of role and text, big end first), a conversation the
string of its ids. Conversations are dealt by range of their first ids, hot ranges parted by conv_id, and
every task builds one radix tree (:mod:`tickweave.llm.radix_tree`) of its share. A node that no other task
can hold is finished there, with all sums over its subtree. The others - prefixes of a task's first or
last key - leave as partial rows, which Spark sums; their subtrees are summed by pointer doubling, in as
many turns as the depth has binary digits. So no task holds more than its range, and a first turn that a
third of all conversations share meets as one partial row a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.common import ASCII_WS, map_arrow, saved
from tickweave.llm.radix_tree import RadixTree
from tickweave.llm.structure_repair import crc32_sql
from tickweave.sources.tables import read_table

WIDTH = 16
RANGE_TURNS = 4  # ids of a key that its range is told by
BLOCK, HEAD_TURNS = 20, 4  # op 12: conversations of a block share up to HEAD_TURNS - 1 first turns

TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = "node binary, parent binary, words long, ends binary, first_end long"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turn ids (hex) and word counts, by turn (nulls first; ties
    by role, then text). Null role and text are empty; rows without a conv_id belong to no conversation.
    A repeated row is a turn of its own. One conversation's ids lie in one row, its texts never do."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select(
        "conv_id", F.row_number().over(order).alias("pos"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("id"),
        F.regexp_count("text", F.lit(f"[^{ASCII_WS}]+")).alias("words"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """(conv_id, key, words) of the rebuilt conversations: the first h turns of conversation c - c % 20 (all
    if it has fewer, none if it is absent), then c's own after its first h, h = crc32(c) % 4."""
    heads = lists.filter(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, HEAD_TURNS - 1).alias("b_ids"), F.slice("words", 1, HEAD_TURNS - 1).alias("b_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int")
    own = lists.select("conv_id", "ids", "words", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    both = own.join(heads, "base", "left")

    def spliced(head: str, tail: str, kind: str):
        start = F.slice(F.coalesce(head, F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(start, F.slice(tail, F.col("h") + 1, F.size(tail)))
    return both.select("conv_id", F.unhex(F.array_join(spliced("b_ids", "ids", "string"), "")).alias("key"),
                       spliced("b_words", "words", "int").alias("words"))


def _share(batches):
    """The nodes of one task's share: finished ones, then partial ones (node not null)."""
    import pyarrow as pa
    ids, keys, words = [], [], []
    tree = RadixTree(WIDTH)
    for batch in batches:
        for c, key, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            tree.insert(key, len(ids))
            ids.append(c)
            keys.append(key)
            words.append(w)
    if not ids:
        return
    cut = RANGE_TURNS * WIDTH
    edges = min(k[:cut] for k in keys), max(k[:cut] for k in keys)
    open_rows: dict[int, list] = {}  # by number: [node, parent, row]
    convs: list[int] = []  # least conv_id by number
    out: list[tuple] = []

    def batch_of(rows):
        names = [x.split()[0] for x in f"{TRIE}, {PARTS}".split(", ")]
        kinds = [pa.binary() if "binary" in x else pa.string() if "string" in x else pa.int64() for x in f"{TRIE}, {PARTS}".split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(*[zip(*rows, strict=True)], kinds, strict=True)], names=names)

    for number, above, depth, least, count, kids, leaves, tokens, ends in tree.nodes(ids, words):
        convs.append(ids[least])
        parent, key = open_rows.get(above), keys[least]
        if number and parent is None or not any(e.startswith(key[:min(depth, cut)]) for e in edges):
            listed = ",".join(map(str, sorted(ids[k] for k in ends)))
            row = [ids[least], depth // WIDTH, None, count, kids, leaves, tokens, hashlib.sha256(listed.encode()).hexdigest()]
            if parent is None:
                out.append((*row[:2], convs[above], *row[3:], None, None, None, None, None))
            else:  # its parent's least conversation is known later
                out.append((*row, None, parent[0], None, None, None))
                parent[2]["kids"] += 1
                parent[2]["leaves"] += leaves
                parent[2]["tokens"] += tokens
        else:
            node = hashlib.md5((parent[0] if parent else b"") + key[max(0, depth - WIDTH):depth]).digest()
            open_rows[number] = [node, parent[0] if parent else None,
                                 {"conv": ids[least], "depth": depth // WIDTH, "count": count, "kids": 0, "leaves": 0, "tokens": 0,
                                  "words": words[least][depth // WIDTH - 1] if depth else 0, "ends": sorted(ids[k] for k in ends)}]
        if len(out) >= 20_000:
            yield batch_of(out)
            out = []
    for node, parent, r in open_rows.values():
        ends = ",".join(map(str, r["ends"])).encode() if r["ends"] else None
        out.append((r["conv"], r["depth"], None, r["count"], r["kids"], r["leaves"], r["tokens"], None,
                    node, parent, r["words"], ends, r["ends"][0] if ends else None))
        if len(out) >= 20_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _end_digests(batches):
    """(node, digest) of pieces of id lists sorted by node and first id."""
    import pyarrow as pa
    node, sha = None, None
    for batch in batches:
        nodes, shas = [], []
        for n, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node:
                if sha:
                    nodes.append(node)
                    shas.append(sha.hexdigest())
                node, sha = n, hashlib.sha256(ends)
            else:
                sha.update(b"," + ends)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], names=["e_node", "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["e_node", "ends_sha256"])


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes that several tasks hold, from their partial rows: (node, and the columns of the trie)."""
    nodes = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"), F.first("words").alias("words"))
    below = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p_node")).agg(F.count(F.lit(1)).alias("more"))
    n_children = F.col("kids") + F.coalesce("more", F.lit(0))
    nodes = saved(nodes.join(below, F.col("node") == F.col("p_node"), "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", n_children.alias("n_children"),
        (F.col("leaves") + F.when(n_children == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("tokens")), "op12-open")
    # sums over subtrees: after k turns a node holds its own and its descendants' within 2^k - 1 steps,
    # and knows its ancestor 2^k steps above
    sums = nodes.select("node", F.col("parent").alias("far"), "leaves", "tokens")
    for _ in range(int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length()):
        gain = sums.filter("far IS NOT NULL").groupBy(F.col("far").alias("g_node")).agg(
            F.sum("leaves").alias("g_leaves"), F.sum("tokens").alias("g_tokens"))
        jump = sums.select(F.col("node").alias("j_node"), F.col("far").alias("farther"))
        sums = saved(sums.join(gain, F.col("node") == F.col("g_node"), "left").join(jump, F.col("far") == F.col("j_node"), "left").select(
            "node", F.col("farther").alias("far"), (F.col("leaves") + F.coalesce("g_leaves", F.lit(0))).alias("leaves"),
            (F.col("tokens") + F.coalesce("g_tokens", F.lit(0))).alias("tokens")), "op12-sums")
    ends = parts.filter("ends IS NOT NULL").select("node", "ends", "first_end").repartition("node").sortWithinPartitions("node", "first_end")
    ends = map_arrow(ends.select("node", "ends"), _end_digests, "e_node binary, ends_sha256 string")
    up = nodes.select(F.col("node").alias("u_node"), F.col("conv_id").alias("parent_conv_id"))
    sums = sums.select(F.col("node").alias("s_node"), F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"))
    return (nodes.join(sums, F.col("node") == F.col("s_node")).join(up, F.col("parent") == F.col("u_node"), "left")
            .join(ends, F.col("node") == F.col("e_node"), "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))


def prefix_trie(keyed: DataFrame) -> DataFrame:
    """One row per trie node of (conv_id, key, words): conversations as strings of ``WIDTH``-byte turn ids,
    with each turn's word count. Keys may be empty (they end at the root); conv_id is unique and not null.
    Columns as in ``TRIE``; the root's parent is null. Without conversations there is no node."""
    names = [x.split()[0] for x in TRIE.split(", ")]
    dealt = keyed.select("conv_id", "key", "words").repartitionByRange(F.substring("key", 1, RANGE_TURNS * WIDTH), "conv_id")
    found = saved(map_arrow(dealt, _share, f"{TRIE}, {PARTS}"), "op12-nodes")
    merged = saved(_merged(found.filter("node IS NOT NULL")).select("node", *names), "op12-merged")
    up = merged.select(F.col("node").alias("u_node"), F.col("conv_id").alias("u_conv"))
    whole = found.filter("node IS NULL").join(up, F.col("parent") == F.col("u_node"), "left")
    whole = whole.withColumn("parent_conv_id", F.coalesce("u_conv", "parent_conv_id"))
    return whole.select(*names).unionByName(merged.select(*names))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(saved(rebuilt(turn_lists(read_table(spark, sf_dir, "conversations"))), "op12-keys"))


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, pos, md5(length(role) || ':' || role || text) AS id,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM t),
turns AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d
  FROM (SELECT c.conv_id, 0 AS own, pos, id, words FROM c JOIN ids ON ids.conv_id = c.base AND pos <= h
        UNION ALL SELECT c.conv_id, 1 AS own, pos, id, words FROM c JOIN ids ON ids.conv_id = c.conv_id AND pos > h)),
paths AS (
  SELECT conv_id, d, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY conv_id) GROUP BY path),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, left(path, greatest(0, 32 * (d - 1))) AS up
  FROM paths GROUP BY path, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
below AS (
  SELECT a.path, count(*) FILTER (k.n IS NULL) AS leaves, sum((x.n - 1) * x.words) AS saved
  FROM nodes x JOIN paths a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids k ON k.up = x.path GROUP BY a.path)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON x.d > 0 AND p.path = x.up LEFT JOIN kids k ON k.up = x.path
JOIN below b ON b.path = x.path LEFT JOIN ends e ON e.path = x.path
"""
