"""The multi-index Hamming join (operator 11) against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tickweave.llm import minhash_join as M

SCHEMA = "doc_id long, text string, lang string, `Key` string, sig string, `comp` long"
EDGE = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "Same Text\n" * 3), (4, "Same Text\n" * 3), (5, "same text\n" * 3),
        (6, "É ß 日本 \U0001f389 it's"), (7, "word " * 30_000), (8, "x" * 5000), (9, "a b c"), (10, "A B C"), (11, "one two"), (12, "ONE  two"),
        (None, "lone null"), (None, None), (13, "É ß 日本 \U0001f389 it's not")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "s", 1) for i, t in rows], SCHEMA)


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out[i, len(sets[k]), c, i == c] += 1
    return out


def families(seed):
    """Edited copies, at similarities around the threshold, with the original and without."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for base in range(14):
        words = [rng.choice(vocab) for _ in range(rng.randint(4, 160))]
        for copy in range(10):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6]) if copy or base % 2 else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + 20 * base + copy, " ".join(w + passage if base % 3 == 0 else w)))
    return rows


def test_components_against_brute_force(spark):
    rows = EDGE + families(3)
    assert Counter(tuple(r) for r in M.near_duplicates(frame(spark, rows)).collect()) == brute(rows)


def test_tables_without_links(spark):
    assert M.near_duplicates(frame(spark, [])).count() == 0
    got = M.near_duplicates(frame(spark, [(3, "a"), (4, "b"), (5, None)])).collect()
    assert sorted(tuple(r) for r in got) == [(3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True)]


def test_pairs_within_the_radius_share_keys_of_two_chunks():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (400, M.PLACES), dtype=np.uint8)
    b = a.copy()
    for row in b:  # as many errors as the radius allows, also dealt two to a chunk
        at = rng.permutation(M.PLACES)[:M.RADIUS] if rng.random() < 0.5 else np.arange(M.PLACES)[np.arange(M.PLACES) % M.CHUNK < 2][:M.RADIUS]
        row[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
    for x, y in zip(M.chunk_keys(a), M.chunk_keys(b)):
        assert len({(k >> 48) // M.CHUNK for k in set(x) & set(y)}) >= 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    far = []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 1150, dtype=np.uint64)
        x, y = np.sort(pool[:1075]), np.sort(pool[75:])  # 1000 of 1150 shared
        far.append((np.frombuffer(M.signature(x), np.uint8) != np.frombuffer(M.signature(y), np.uint8)).mean())
    assert abs(np.mean(far) - 150 / 1150) < 0.01 and max(far) * M.PLACES <= M.RADIUS


def brute_pairs(cls, comp, n, sigs):
    return {(min(cls[i], cls[j]), max(cls[i], cls[j])) for i in range(len(cls)) for j in range(i)
            if comp[i] != comp[j] and 20 * min(n[i], n[j]) >= 17 * max(n[i], n[j]) and (sigs[i] != sigs[j]).sum() <= M.RADIUS}


def test_lists_cut_by_second_chunk_and_blocks_meet_each_pair_once(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, M.PLACES, dtype=np.uint8)
    sigs = np.repeat(base[None], 60, axis=0)
    for row in sigs:
        at = rng.permutation(M.PLACES)[:rng.integers(5, 26)]
        row[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
    centres = [None if k % 3 else [int(c) for c in rng.integers(0, 5, k % 4)] for k in range(60)]
    cls, comp, n = np.arange(60) - 30, rng.integers(0, 40, 60), rng.integers(90, 110, 60)
    lists = {}
    for c, keys in enumerate(M.chunk_keys(sigs)):
        for k in keys:
            lists.setdefault(int(k), []).append(c)
    monkeypatch.setattr(M, "BLOCK", 8)
    got = Counter()
    for key, members in lists.items():
        m = np.array(members)
        table = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(m), key)), pa.array(np.full(len(m), len(m))), pa.array(cls[m]), pa.array(comp[m]), pa.array(n[m]),
             pa.array([s.tobytes() for s in sigs[m]]), pa.array([centres[c] for c in m], pa.list_(pa.int64()))],
            names=["key", "size", "cls", "comp", "n", "sig", "centres"])
        cut = {}
        for batch in M._second_lists([table]):
            for row in batch.to_pylist():
                cut.setdefault(row["sub"], []).append(row)
        for sub, rows in cut.items():
            assert (sub == -1) == (len(m) <= 8)
            c = np.array([r["cls"] for r in rows])
            block = c % 3
            for b1 in range(3):
                for b2 in range(b1, 3):
                    k = np.isin(block, (b1, b2))
                    if k.any():
                        got.update(M.list_pairs(key, sub, b1 == b2, block[k], c[k], np.array([r["comp"] for r in rows])[k],
                                                np.array([r["n"] for r in rows])[k], M.sig_matrix([r["sig"] for r in rows])[k],
                                                [r["centres"] for r, here in zip(rows, k) if here]))
    met = {(min(cls[i], cls[j]), max(cls[i], cls[j])) for i in range(60) for j in range(i) if set(centres[i] or ()) & set(centres[j] or ())}
    want = brute_pairs(cls, comp, n, sigs) - met
    assert set(got) == want and set(got.values()) == {1}


def test_links_around_a_centre_are_exact():
    rng = np.random.default_rng(6)
    centre = np.unique(rng.integers(0, 1 << 60, 300, dtype=np.uint64))
    spare = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
    sets = []
    for _ in range(50):
        cut, more = rng.integers(0, 70), rng.integers(0, 30)
        sets.append(np.unique(np.concatenate([rng.permutation(centre)[cut:], rng.permutation(spare)[:more]])))
    comp = rng.integers(0, 30, 50)
    own = np.where(comp < 12, -1 - comp % 2, comp % 3)
    diff = lambda a, b: np.setdiff1d(a, b).tobytes()

    def found(rows, o, m):
        table = pa.table({"cls": rows, "comp": comp[rows], "n": [len(sets[k]) for k in rows], "own": own[rows], "o": [o] * len(rows), "m": [m] * len(rows),
                          "minus": [diff(centre, sets[k]) for k in rows], "plus": [diff(sets[k], centre) for k in rows]})
        return {tuple(r.values()) for r in M._around(table).to_pylist()}

    def joined(pairs):
        root = comp.copy()
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r)) for r in root}

    everything = np.arange(50)
    linked = {(a, b) for b in range(50) for a in range(b) if comp[a] != comp[b] and M.linked(sets[a], sets[b])}
    got = found(everything, 0, 0)
    assert got <= linked and joined(got) == joined(linked) and len(got) < 30 < len(linked)
    apart = found(everything[np.isin(own, (1, -1))], 1, -1)
    assert apart <= {p for p in linked if own[p[0]] != own[p[1]]}
    sizes = M.common(sets, columns=7)
    assert all(sizes[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(50) for b in range(a))
