"""Conversation operators (12 and 13) against brute force on small tables."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickweave.llm import prefix_trie, radix_tree, structure_repair

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, `node` string, `Pos` long, ids string"


def table(spark, rows):
    """Conversations with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "n", 1, "i") for r in rows], SCHEMA)


def some_rows(seed, convs=90, deep=70):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            text = rng.choice([None, "", " \t", "Yes.", "So it is!", "no end", "A b c d?", "é ß 日本."])
            rows.append((c, rng.choice([t, t, t, None, t // 2]), role, text))
    rows += [(200 + k, t, "user", "The same start.") for k in range(40) for t in range(5)]  # a hot conversation
    rows += [(300, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(deep)]
    rows += [(310, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(deep - 9)]
    rows += [(7, 0, "user", "again."), (7, 0, "user", "again."), (None, 0, "user", "x."), (None, None, None, None), (-5, 0, "user", "long " * 5000)]
    return rows


def in_order(rows, null):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, null if role is None else role, null if text is None else text))
    return {c: [(x[2], x[3], x[1] if x[0] else None) for x in sorted(v)] for c, v in by.items()}


# --- 12: prefix trie --------------------------------------------------------------------------------

def brute_trie(rows):
    turns = {c: [x[:2] for x in v] for c, v in in_order(rows, "").items() if c is not None}
    convs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = turns.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for path, m in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(path))))
        out.add((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids), len(leaves), saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows):
    return [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, rows)))).collect()]


@pytest.mark.parametrize("parts", [1, 23])
def test_trie_against_brute_force(spark, parts):
    """Also with more ranges than conversations of the hot group, so that its nodes meet from many tasks."""
    rows = some_rows(3, deep=24)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = trie(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_no_and_of_turnless_conversations(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 0, "user", "x")]) == []
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its base is absent, its turn goes
    assert trie(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, [])))).columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_radix_tree_grows_and_compresses():
    rng = random.Random(1)
    tree, keys = radix_tree.RadixTree(4), []
    for first in range(256):
        keys += [bytes([first]) + rng.randbytes(3), bytes([first]) + b"abc" + rng.randbytes(4) + b"long tail ab"]
    keys += [b"\x07abc" + bytes([0, 0, 0, k]) for k in range(60)] + [b""]
    layouts = set()
    for k, key in enumerate(keys):
        tree.insert(key, k)
        layouts.add(tree.root.layout)
    assert layouts == {4, 16, 48, 256}
    assert tree.root.child(9) is not None and tree.root.child(9).child(1) is None
    nodes = list(tree.nodes(list(range(len(keys))), [[1] * (len(k) // 4) for k in keys]))
    prefixes = {key[:x] for key in keys for x in range(0, len(key) + 1, 4)}
    paths = {keys[n[3]][:n[2]] for n in nodes}
    assert paths == prefixes and len(nodes) == len(prefixes)
    for number, above, depth, least, count, kids, leaves, saved, ends in nodes:
        path = keys[least][:depth]
        assert count == sum(k.startswith(path) for k in keys)
        assert kids == sum(p.startswith(path) and len(p) == depth + 4 for p in prefixes)
        assert sorted(ends) == [k for k, key in enumerate(keys) if key == path]
        assert saved == sum(sum(k.startswith(p) for k in keys) - 1 for p in prefixes if p and p.startswith(path))
    spans = list(tree._spans())
    assert len(spans) < len(prefixes) and any(last - first >= 8 for _, first, last in spans)  # chains are one node


# --- 13: structure repair ---------------------------------------------------------------------------

def brute_audit(pattern):
    n = len(pattern)

    @functools.cache
    def go(i, q, inserted):
        best = [(0, "")] if i == n and q in structure_repair.SOUND_ENDS else []
        for role, to in structure_repair.STEP[q].items():
            if role != "s" and inserted < 2:
                best += [(c + 2, "I" + a) for c, a in go(i, to, inserted + 1)]
        if i < n:
            best += [(c + 3, "D" + a) for c, a in go(i + 1, q, 0)]
            for role, to in structure_repair.STEP[q].items() if pattern[i] != "D" else ():
                extra = pattern[i].isupper()
                for c, a in go(i + 1, to, 0):
                    best += [(c + extra, "K" + a)] * (role == pattern[i].lower()) + [(c + extra + 2, "R" + a)] * (role != "s")
        return [min(best)] if best else []
    return go(0, 0, 0)[0]


def test_audits_against_dynamic_programming():
    rng = random.Random(2)
    patterns = ["".join(p) for n in range(4) for p in itertools.product("DsuaxSUAX", repeat=n)]
    patterns += ["".join(rng.choice("DsuauauaxSUAX") for _ in range(rng.randint(4, 40))) for _ in range(800)]
    for p in patterns:
        assert structure_repair.cheapest_audit(p) == brute_audit(p), p
    assert structure_repair.cheapest_audit("ua" * 20_000 + "u") == (2, "K" * 40_001 + "I")


def brute_repair(rows):
    damaged = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        damaged += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    convs, out = in_order(damaged, " "), set()
    for c in {r[0] for r in rows}:
        seq, faults, seen = convs.get(c, []), [], set()
        for role, text, _ in seq:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        code = [("D" if f in ("b", "d") else (i := r[:1] if r[:1] in ("s", "u", "a") else "x") and (i.upper() if f else i))
                for (r, _, _), f in zip(seq, faults)]
        cost, audit = brute_audit("".join(code))
        lines, rest = [], iter(seq)
        for edit in audit:
            last = lines[-1].split(":")[0] if lines else ""
            due = "assistant" if last.startswith("u") else "user"
            role, text, _ = next(rest) if edit != "I" else (None, "", None)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else due}:{text}")
        turns = [t for _, _, t in seq if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(seq, seq[1:]))
        out.add((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                 hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_repair_against_brute_force(spark):
    rows = some_rows(4)
    got = [tuple(r) for r in structure_repair.damage_and_repair(table(spark, rows)).collect()]
    assert len(got) == len({r[0] for r in rows}) and set(got) == brute_repair(rows)


def test_repaired_turns_are_sound(spark):
    rows = some_rows(5)
    found, turns = structure_repair.repair_conversations(table(spark, rows))
    by = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        by[r.conv_id].append(r)
    for r in found.collect():
        kept = by[r.conv_id]
        assert [x.place for x in kept] == list(range(1, len(kept) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in kept))
        assert "".join(x.edit for x in kept) == r.audit.replace("D", "")
    assert structure_repair.damage_and_repair(table(spark, [])).count() == 0


def test_crc32_expression_of_the_twins():
    import duckdb
    for text in ("0", "17", "-5", " :3", "12345:398"):
        assert duckdb.execute(f"SELECT {structure_repair.crc32_sql('?')}", [text]).fetchone()[0] == zlib.crc32(text.encode())
