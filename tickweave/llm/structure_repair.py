"""Conversation structure repair by bidirectional Dijkstra over the edit lattice (operator 13).

A conversation is sound when its role initials read ``(s?(ua)+)?``. Repair keeps, reroles, deletes or
inserts turns at least cost; the list of edits is its audit (letters K, R, D, I), and of equally cheap
audits the ASCII-least is taken.

* Spark numbers each conversation's rows, finds blank, repeated and truncated ones, and gathers one
  letter a row (the pattern): texts are never gathered.
* :func:`cheapest_audit` searches the lattice (rows read) x (role state) of one pattern from both ends:
  a forward and a reverse heap settle nodes by cost until no crossing can be as cheap as the best one,
  so that every equally cheap path has a crossing edge; the least audit is then read off, letter by
  letter, over the nodes that lie on such paths.
* The audit is laid ahead of its conversation's rows in one sorted stream, and the repaired turns leave
  as the rows pass: memory holds an audit and a batch, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.common import ASCII_WS, BoundedCache, map_arrow, per_process
from tickweave.sources.tables import read_table

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs; keeping costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired turns so far end with
#: Where a role initial leads from each state; a missing entry fits nowhere.
STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
SOUND_ENDS = (START, ASSISTANT)
INSERTED = {USER: "user", ASSISTANT: "assistant"}


# --- the lattice ----------------------------------------------------------------------------------

def row_moves(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of reading one row. A code is ``D`` for a row that has to go,
    else its role initial (``x`` for any that fits nowhere), upper case when the row is truncated."""
    moves = {(q, q): (DELETE, "D") for q in range(4)}
    if code != "D":
        extra, initial = TRUNCATED * code.isupper(), code.lower()
        for q, step in enumerate(STEP):
            for role, to in step.items():
                if role != "s":
                    moves[q, to] = min(moves.get((q, to), (99, "")), (REROLE + extra, "R"))
            if initial in step:
                moves[q, step[initial]] = (extra, "K")
    return [(q, to, cost, letter) for (q, to), (cost, letter) in moves.items()]


def by_state(moves, at: int, to: int) -> list[list[tuple[int, int, str]]]:
    return [[(m[to], m[2], m[3]) for m in moves if m[at] == q] for q in range(4)]


ROWS = {code: (by_state(row_moves(code), 0, 1), by_state(row_moves(code), 1, 0)) for code in "DsuaxSUAX"}
_INSERTS = [(q, to, INSERT, "I") for q, step in enumerate(STEP) for role, to in step.items() if role != "s"]
INSERTS = by_state(_INSERTS, 0, 1), by_state(_INSERTS, 1, 0)


def cheapest_audit(pattern: str) -> tuple[int, str]:
    """(cost, ASCII-least audit) of the cheapest repair of a pattern of row codes."""
    n = len(pattern)
    goals = [4 * n + q for q in SOUND_ENDS]

    def ahead(v):
        i, q = divmod(v, 4)
        for to, cost, letter in INSERTS[0][q]:
            yield 4 * i + to, cost, letter
        if i < n:
            for to, cost, letter in ROWS[pattern[i]][0][q]:
                yield 4 * i + 4 + to, cost, letter

    def behind(v):
        i, q = divmod(v, 4)
        for to, cost, letter in INSERTS[1][q]:
            yield 4 * i + to, cost, letter
        if i:
            for to, cost, letter in ROWS[pattern[i - 1]][1][q]:
                yield 4 * i - 4 + to, cost, letter

    near = {START: 0}, dict.fromkeys(goals, 0)  # tentative costs from the start, to the end
    heaps = [(0, START)], [(0, v) for v in goals]
    settled: tuple[dict, dict] = {}, {}
    best = DELETE * n  # everything deleted
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, v = heapq.heappop(heaps[side])
        if v in settled[side]:
            continue
        settled[side][v] = cost
        for w, c, _ in (ahead, behind)[side](v):
            if cost + c < near[side].get(w, best + 1):
                near[side][w] = cost + c
                heapq.heappush(heaps[side], (cost + c, w))
            if w in near[1 - side]:
                best = min(best, cost + c + near[1 - side][w])

    from_start, to_end = settled
    on_path = {}  # forward nodes on a cheapest path: the edges that stay on one
    for v in sorted(from_start, key=lambda v: (from_start[v], v), reverse=True):
        cost, edges = from_start[v], []
        for w, c, letter in ahead(v):
            if cost + c + to_end.get(w, best + 1) == best or w in on_path and cost + c == from_start[w]:
                edges.append((letter, w))
        if edges or v in goals and cost == best:
            on_path[v] = edges
    audit, here, spent = [], {START}, 0
    while True:  # all nodes in here have one audit so far, so one number of rows and one cost
        edges = set()
        for v in here:
            edges.update(on_path.get(v, ()))
            if to_end.get(v, best + 1) + spent == best:
                edges.update((letter, w) for w, c, letter in ahead(v) if w in to_end and c + to_end[w] == to_end[v])
        if not edges:
            return best, "".join(audit)
        letter = min(edges)[0]
        row = min(here) >> 2
        extra = TRUNCATED * (row < n and pattern[row] in "SUAX")
        spent += {"D": DELETE, "I": INSERT, "K": extra, "R": REROLE + extra}[letter]
        here = {w for x, w in edges if x == letter}
        audit.append(letter)


# --- Spark ----------------------------------------------------------------------------------------

def diagnosed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, fault, illegal, step, code): rows in order of turn (nulls first),
    then role and text, with each row's first fault; ``step`` marks a turn number not met before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    last = F.regexp_extract("text", f"([^{ASCII_WS}])[{ASCII_WS}]*\\z", 1)
    rows = turns.select("conv_id", "turn", "role", "text").select(
        "*", F.row_number().over(order).alias("pos"), initial.alias("initial"), last.alias("last"),
        F.concat(F.lag(initial).over(order), initial).alias("pair"), F.lag("turn").over(order).alias("before"))
    fault = (F.when(F.col("last") == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise(""))
    rows = rows.select(
        "conv_id", "pos", "turn", "role", "text", "initial", fault.alias("fault"),
        ((F.col("pos") > 1) & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).alias("step"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = (F.when(F.col("fault").isin("blank", "duplicate"), "D")
            .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known))
    return rows.select("conv_id", "pos", "turn", "role", "text", "fault", "illegal", "step", code.alias("code"))


def _audits(batches):
    import pyarrow as pa
    cache = per_process("audits", partial(BoundedCache, 100_000))
    for batch in batches:
        found = []
        for pattern in batch.column("pattern").to_pylist():
            if len(pattern) > 64:
                found.append(cheapest_audit(pattern))
                continue
            if pattern not in cache:
                cache.room(1)
                cache[pattern] = cheapest_audit(pattern)
            found.append(cache[pattern])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=[*batch.schema.names[:-1], "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of :func:`diagnosed` rows: counts of faults, missing turn numbers (gaps),
    illegal neighbours, the repair's cost and audit."""
    count = lambda kind: F.sum((F.col("fault") == kind).cast("long")).alias(kind)
    gaps = F.max("turn") - F.min("turn") + 1 - F.sum(F.col("step").cast("long"))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    found = rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"),
        F.sum(F.col("illegal").cast("long")).alias("illegal"), pattern.alias("pattern"))
    kind = dict(rows.dtypes)["conv_id"]
    return map_arrow(found, _audits, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                     "cost long, audit string")


def _repaired(batches):
    """Repaired turns of a stream sorted by conversation and place, its audit first."""
    import pyarrow as pa
    audit, at, state, place, conv, schema = "", 0, START, 0, None, None
    out: list[tuple] = []

    def put(role, text, edit):
        nonlocal place
        place += 1
        out.append((conv, place, role, text, edit))

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = STEP[state]["a" if state == USER else "u"]
            put(INSERTED[state], "", "I")
            at += 1

    def flush():
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema, strict=True)],
                                           names=["conv_id", "place", "role", "text", "edit"])
        out.clear()
        return batch

    for batch in batches:
        schema = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for c, pos, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if pos == 0:  # a new conversation
                inserts()
                conv, audit, at, state, place = c, text, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = STEP[state][role[0]]
                put(role, text, edit)
            elif edit == "R":
                state = STEP[state]["a" if state == USER else "u"]
                put(INSERTED[state], text, edit)
        yield flush()
    if schema:
        inserts()
        yield flush()


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations. Those of one
    conversation follow one another within a partition."""
    head = found.select("conv_id", F.lit(0).alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = head.unionByName(rows.select("conv_id", "pos", "role", "text"))
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    kind = dict(rows.dtypes)["conv_id"]
    return map_arrow(stream, _repaired, f"conv_id {kind}, place long, role string, text string, edit string")


def _digests(batches):
    import pyarrow as pa
    conv, sha, schema = None, None, None
    for batch in batches:
        ids, shas = [], []
        schema = batch.schema.field(0).type
        for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if place == 1:
                if sha:
                    ids.append(conv)
                    shas.append(sha.hexdigest())
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(shas, pa.string())], names=["conv_id", "sha"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([conv], schema), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of rows (conv_id, turn, role, text), null role and text as one space.

    Rows of a conversation are taken by turn (nulls first; ties by role, then text); a null conv_id is a
    conversation of its own, repeated rows are duplicates, an empty text is blank, an empty role fits
    nowhere. Other columns are not read. An empty table gives empty results."""
    rows = diagnosed(turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                  F.coalesce("text", F.lit(" ")).alias("text")))
    found = audits(rows)
    return found, repaired_turns(rows, found)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(``conv_id:turn``) % 20: 0 drops the row,
    1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                                (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("hit != 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the table, also of those that lose every row to the damage (zeros, an
    empty audit and the digest of the empty string)."""
    found, turns = repair_conversations(damaged(conversations))
    digests = map_arrow(turns, _digests, f"d_id {dict(turns.dtypes)['conv_id']}, sha string")
    every = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"))
    found = found.withColumnRenamed("conv_id", "f_id")
    out = (every.join(found, F.col("conv_id").eqNullSafe(F.col("f_id")), "left")
           .join(digests, F.col("conv_id").eqNullSafe(F.col("d_id")), "left"))
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(read_table(spark, sf_dir, "conversations"))


def crc32_sql(text: str) -> str:
    """DuckDB's form of the CRC-32 of an ASCII string expression (DuckDB has no such function)."""
    bits = ("list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
            "lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, byte: {bits}), 4294967295)"


#: The lattice from its end: best (cost, audit, lines) of the rows after a place, for each state.
OP13_SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
  FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, generate_series(1, CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM num),
diag AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM diag GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS b0, {{'c': 4::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS b1,
         {{'c': 2::BIGINT, 'a': 'I', 'l': ['assistant:']}} AS b2, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS b3
  FROM stats
  UNION ALL
  SELECT conv_id, i, list_min(list_filter([r0, s2, s3], lambda x: x IS NOT NULL)), list_min([r1, s2, s3]), list_min([r2, t3]), list_min([r3, s2])
  FROM (
    SELECT conv_id, i, r0, r1, r2, r3,
           {{'c': r2.c + 2, 'a': 'I' || r2.a, 'l': list_prepend('user:', r2.l)}} AS s2,
           {{'c': r3.c + 4, 'a': 'II' || r3.a, 'l': list_prepend('user:', list_prepend('assistant:', r3.l))}} AS s3,
           {{'c': r3.c + 2, 'a': 'I' || r3.a, 'l': list_prepend('assistant:', r3.l)}} AS t3
    FROM (
      SELECT conv_id, i,
             list_min(list_filter([d0, CASE WHEN NOT gone AND ini = 's' THEN k1 END, CASE WHEN NOT gone AND ini = 'u' THEN k2 END, CASE WHEN NOT gone THEN u2 END], lambda x: x IS NOT NULL)) AS r0,
             list_min(list_filter([d1, CASE WHEN NOT gone AND ini = 'u' THEN k2 END, CASE WHEN NOT gone THEN u2 END], lambda x: x IS NOT NULL)) AS r1,
             list_min(list_filter([d2, CASE WHEN NOT gone AND ini = 'a' THEN k3 END, CASE WHEN NOT gone THEN a3 END], lambda x: x IS NOT NULL)) AS r2,
             list_min(list_filter([d3, CASE WHEN NOT gone AND ini = 'u' THEN k2 END, CASE WHEN NOT gone THEN u2 END], lambda x: x IS NOT NULL)) AS r3
      FROM (
        SELECT b.conv_id, b.i - 1 AS i, d.fault IN ('b', 'd') AS gone, left(d.role, 1) AS ini, (d.fault = 't')::BIGINT AS t,
               {{'c': b0.c + 3, 'a': 'D' || b0.a, 'l': b0.l}} AS d0, {{'c': b1.c + 3, 'a': 'D' || b1.a, 'l': b1.l}} AS d1,
               {{'c': b2.c + 3, 'a': 'D' || b2.a, 'l': b2.l}} AS d2, {{'c': b3.c + 3, 'a': 'D' || b3.a, 'l': b3.l}} AS d3,
               {{'c': b1.c + t, 'a': 'K' || b1.a, 'l': list_prepend(d.role || ':' || d.text, b1.l)}} AS k1,
               {{'c': b2.c + t, 'a': 'K' || b2.a, 'l': list_prepend(d.role || ':' || d.text, b2.l)}} AS k2,
               {{'c': b3.c + t, 'a': 'K' || b3.a, 'l': list_prepend(d.role || ':' || d.text, b3.l)}} AS k3,
               {{'c': b2.c + t + 2, 'a': 'R' || b2.a, 'l': list_prepend('user:' || d.text, b2.l)}} AS u2,
               {{'c': b3.c + t + 2, 'a': 'R' || b3.a, 'l': list_prepend('assistant:' || d.text, b3.l)}} AS a3
        FROM best b JOIN diag d ON d.conv_id IS NOT DISTINCT FROM b.conv_id AND d.pos = b.i)))),
done AS (SELECT conv_id, b0 FROM best WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost,
       coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
