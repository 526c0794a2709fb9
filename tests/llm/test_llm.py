"""The training-data operators against SQL twins, brute force, the tokenizers library and held-out labels."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle_harness as H
from conftest import SF_SMALL
from tickweave.llm import bpe, exact_dedup, licenses, line_dedup, ngram_join, packing, quality, queries, secrets, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, `Key` string, sha string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "k", "s") for i, t in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "Same Text\n" * 3), (4, "Same Text\n" * 3), (5, "same text\n" * 3),
        (6, "É ß 日本 \U0001f389 <|endoftext|> it's"), (7, "word " * 30_000), (8, "x" * 5000), (9, "a b c"), (10, "A B C")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, name):
    r = H.compare(spark, H.duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLE[name], SF_SMALL)
    assert r["ok"], r.get("why")


def test_exact_groups_edges(spark):
    got = exact_dedup.exact_groups(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    texts = {}
    for i, t in EDGE:
        texts.setdefault(hashlib.sha256(low(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = texts[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(texts.keys())  # exactly one of each
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_line_dedup_edges(spark):
    run = "\n".join(f"line {k} has exactly these six words" for k in range(9))
    docs = frame(spark, [*EDGE, (20, "own start\n" + run + "\nown end"), (21, run + "\n\nother"), (22, f"tiny\n{run[:80]}")])
    got = {(r.doc_id, r.n_removed): r for r in line_dedup.dedup_lines(docs).collect()}
    assert (20, 0) in got and got[(21, 9)].text == "\nother" and (22, 0) in got
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    emptied = frame(spark, [(1, run), (2, run)])
    assert [r.doc_id for r in line_dedup.dedup_lines(emptied, drop_emptied=True).collect()] == [1]


def test_line_dedup_deletes_whole_runs(spark):
    """Uneven lines: what follows a long line in a repeated run goes with it, as far as the run goes;
    the longest match may lie at another place than the first one."""
    long, short = " ".join(f"l{k}" for k in range(60)), [" ".join(f"s{j}x{k}" for k in range(8)) for j in range(5)]
    run = [long, *short]
    rows = [(1, "\n".join(["before one", *run, "after one"])), (2, "\n".join(["before two", *run, "", "after two"])),
            (3, "\n".join([long, "own line"])), (4, "\n".join([short[4], *run[:3], "other end"])),
            (5, "\n".join([long, "own line", short[0]]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("before two\n\nafter two", 6)
    assert got[3] == ("own line", 1) and got[4] == (short[4] + "\nother end", 3)
    assert got[5] == (short[0], 2)  # the long line first lies in 1, with the line after it in 3


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets.append((i, frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 4 * len(x & y) >= 3 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


def test_ngram_components_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = list(EDGE)
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(6, 140))]
        for copy in range(9):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if base % 3 == 0:
                w = w + passage
            rows.append((100 + 20 * base + copy, " ".join(w)))
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    kept = [r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(i for i in kept if i is not None and i >= 100) == sorted({c for i, n, c in got if i is not None and i >= 100})
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_keep_one_keeps_an_ids_unlinked_text(spark):
    """One id with two texts: only the near copy of the smaller id goes."""
    copied, own = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, copied), (2, copied + " more"), (2, own), (3, own + " tail"), (4, "c d e f g h"), (4, "c d e f g h"), (5, ""), (5, None)]
    got = ngram_join.keep_one(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([rows[0], rows[2], rows[4], rows[6], rows[7]])
    assert got[0].__fields__ == frame(spark, []).columns


def test_centre_rounds_lose_no_link(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0.01)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    assert Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()) == brute_components(rows)


def test_text_chunks_of_an_arrow_column():
    """A worker takes an Arrow column some rows at a time: the pieces are those of the whole list."""
    import pyarrow as pa

    from tickweave.llm.common import column_values, text_chunks
    texts = [None, "", "a" * 50, "b" * 200] * 300 + ["c" * 10]
    column = pa.array(texts, pa.string()).slice(1)
    assert list(column_values(column)) == texts[1:]
    pieces = list(text_chunks(column, 120))
    assert pieces == list(text_chunks(texts[1:], 120))
    assert [t for _, part in pieces for t in part] == [t or "" for t in texts[1:]]


def test_saved_tables_take_small_arrow_batches(spark):
    """No batch of a saved table's Arrow map has more than ARROW_ROWS rows; the session's setting stays."""
    from tickweave.llm.common import ARROW_ROWS, map_arrow, saved
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    out = saved(map_arrow(spark.range(0, 5 * ARROW_ROWS, 1, 1), count, "n long"), "batches")
    sizes = [r.n for r in out.collect()]
    assert max(sizes) <= ARROW_ROWS and sum(sizes) == 5 * ARROW_ROWS
    assert spark.conf.get(key) == before


def test_marks_bound_the_overlap_of_sets_of_any_size():
    rng = np.random.default_rng(3)
    near = 0
    for _ in range(400):
        n = int(rng.integers(1, 400)) if rng.random() < 0.9 else int(rng.integers(4000, 9000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.5, 0.8, 0.95, 1.0])], other]))
        may = ngram_join.may_link(ngram_join.marks(a), ngram_join.marks(b), len(a), len(b))
        assert may or not ngram_join.linked(a, b)
        near += may
    assert 0 < near < 400


def test_far_pairs_move_no_text(spark, monkeypatch):
    """Neighbours share half of their text, and no prefix is without a shared shingle: they meet, but their
    marks rule the link out before a text is asked for."""
    rng = random.Random(13)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, f"{passages[i]} {passages[(i + 1) % 40]}") for i in range(40)]
    rows += [(100, rows[0][1] + " tail"), (101, rows[7][1] + " of another")]
    seen, saved = {}, ngram_join.saved

    def spy(df, name):
        out = saved(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(ngram_join, "saved", spy)
    assert Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()) == brute_components(rows)
    assert seen["op5-tested"] < 10 < seen["op5-met"]


def test_a_centres_pairs_in_many_groups(spark, monkeypatch):
    """Repeated rows and a centre's text in several groups: every pair is decided once and rightly."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        rows += [(i, " ".join(w))] * rng.choice([1, 1, 3])
    rows += [(None, rows[0][1]), (None, rows[5][1] + " more"), (None, rows[5][1] + " more")]
    monkeypatch.setattr(ngram_join, "GROUP_PAIRS", 4)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0.01)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    assert Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()) == brute_components(rows)


def test_ngram_links_of_long_texts(spark):
    """Prefixes beyond the largest place that postings tell apart, similarities on both sides of 0.75."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(300)]
    rows = []
    for base in range(4):
        words = [rng.choice(vocab) for _ in range(1300)]
        for copy in range(10):
            w = list(words)
            for _ in range(rng.randint(10, 50)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
            rows.append((10 * base + copy, " ".join(w[rng.randrange(150):] + passage)))
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert 4 < len({c for _, _, c in got}) < 40


def brute_quality(t):
    t = t or ""
    w = WORDS.findall(t)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - k, t) for k, (_, t) in enumerate(EDGE)]
    want = dict(rows)
    for r in quality.quality_rules(frame(spark, rows)).collect():
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == brute_quality(want[r.doc_id])
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)
    kept = quality.quality_rules(frame(spark, rows), keep_columns=True)
    assert kept.columns == frame(spark, rows).columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    good = [r for r in quality.quality_rules(docs).collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(r.kept for r in good)


def test_quality_tells_junk_from_prose():
    """Base64, random letters, symbols and mojibake leave their bands; clean text of several scripts stays."""
    import base64
    rng = random.Random(1)
    cache = quality.WordTokens(quality.tokenizer_path(quality.VOCABULARY))
    some = lambda letters, n=150: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    clean = ["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
             "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
             "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
             "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
             "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다."]
    junk = [" ".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(20)), some("bcdfghjklmnpqrstvwxz"),
            some("abcdefghijklmnopqrstuvwxyz"), some("#*$%&|<>~^@!{}[]"), clean[1].encode().decode("latin-1") * 2,
            clean[2].encode().decode("latin-1"), some("".join(map(chr, range(0x4E00, 0x9FA5)))), some("".join(map(chr, range(0xAC00, 0xD7A3))))]
    got = quality.fertility_ok(quality.measure([*clean, *junk], cache), quality.BANDS)
    assert got[:len(clean)].all() and not got[len(clean):].any()
    long = quality.measure(["x" * 5000], cache)
    assert long["n_multi"][0] > 0


def test_secret_spans(spark):
    field = secrets.train_field(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    texts = ['É password = "abcdef1" x', "token:abc", "API_KEY=zzzzzz1 passwd='q.w-e_r/t'", "AKIA" + "Z" * 16 + " " + "0a" * 12, None, "",
             "Kelvin to\u212aen=abcdef7", "0a" * 11]
    rows = list(enumerate(texts))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.scan_secrets(frame(spark, rows), field=field).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(s for _, _, s in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(frame(spark, rows), field=field).collect()}
    assert masked[0] == "É [SECRET]\" x" and masked[4] is None and len(masked) == len(rows)


def test_field_finds_unseen_secrets():
    rng = random.Random(3)
    data = []
    for k in range(300):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(20))
        raw = f"some words here password={value} and more words".encode() if k % 2 else f"ref item{k}number{k} of words".encode()
        data += [(secrets.token_features(raw, s, k % 4 == 1), secrets.span_tags(raw, s)) for s in secrets.sequences(raw)]
    field = secrets.Field().train(data)
    raw = b"the auth_hash: 66213754e9ea22e86d and more"
    assert [raw[a:b] for _, a, b in secrets.crf_spans(raw, field)] == [b"66213754e9ea22e86d"]


def full_viterbi(raw, field):
    """Spans of the best path by the field's own steps through all tokens."""
    out = []
    for spans in secrets.sequences(raw):
        tags = field.viterbi(secrets.token_features(raw, spans))
        for i in (i for i, t in enumerate(tags) if t == secrets.BEGIN):
            j = i
            while j + 1 < len(tags) and tags[j + 1] == secrets.INSIDE:
                j += 1
            out.append((3, spans[i][0], spans[j][1]))
    return out


def test_tagger_finds_the_path_over_all_tokens(monkeypatch):
    rng, bits = random.Random(1), ["token", " ", "\n", "=", '"', ":", "é日", "a1b2c3", "Pass-word", "!!", "x" * 30, ".", "\t  ", "zz 9"]
    found = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        field = secrets.Field(r.normal(0, 0.4 + seed % 3, (secrets.N_FEATURES, 3)), r.normal(0, 1 + seed % 4, (3, 3)))
        field.emit[secrets.bucket("bias"), secrets.OUT] += seed % 5 * 3
        tagger = secrets.Tagger(field)
        tagger.STEP = 7 if seed % 2 else tagger.STEP
        for k in range(20):
            raw = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 60]))).encode()
            want = full_viterbi(raw, field)
            assert tagger.spans(raw) == want
            found += len(want)
    assert found > 100


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    s, move = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    paths = list(itertools.product(range(3), repeat=4))
    weight = np.array([np.exp(sum(s[0, t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    weight /= weight.sum()
    padded = np.concatenate([s, r.normal(size=(1, 2, 3))], axis=1)
    prob, steps = secrets.marginals(padded, move, np.array([[True] * 4 + [False] * 2]))
    for t in range(4):
        assert prob[0, t] == pytest.approx([sum(w for w, p in zip(weight, paths) if p[t] == k) for k in range(3)])
    assert not prob[0, 4:].any()
    for a in range(3):
        assert steps[a] == pytest.approx([sum(w * sum(x == (a, b) for x in zip(p, p[1:])) for w, p in zip(weight, paths)) for b in range(3)])


def test_every_token_is_tagged():
    """Short secrets, joined words, and ones under names the patterns lack are found; plain text is not marked, and
    a character is never parted."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    some = [f'{line(30)}\n{line(5)} token = "{rng.randbytes(20).hex()}" {line(30)}'.encode() for _ in range(60)]
    plain = [f"{line(40)}, é日本 {rng.randrange(99)} {line(9)}. {line(20)}".encode() for _ in range(200)]
    field = secrets.Field().train(secrets.training_sequences(some) + secrets.training_sequences(plain))
    tagger, hits = secrets.Tagger(field), Counter()
    for value in ("x7k2m9q", "orange-table-winter-cloud", "Zk39vQpL0aYw81Bd", "0f3a9c41d2e86b75"):
        for k in range(20):
            head = f"{line(20)}\n{line(4)} {word()}_hash = \"".encode()
            spans = tagger.spans(head + value.encode() + f'" {line(20)}'.encode())
            hits[value] += (3, len(head), len(head) + len(value)) in spans
    assert all(hits[v] >= 18 for v in ("x7k2m9q", "orange-table-winter-cloud", "Zk39vQpL0aYw81Bd", "0f3a9c41d2e86b75")), hits
    assert sum(len(tagger.spans(f"{line(40)}, é日本 {rng.randrange(99)} {line(9)}".encode())) for _ in range(100)) <= 2


def test_field_learns_from_both_classes(spark, monkeypatch):
    """Texts with base spans that fill their bound leave the other class its own."""
    with_span = [(k, f"some words here password=abc{k}def0123456 and more words") for k in range(30)]
    without = [(100 + k, f"ref item{k}number{k} of words") for k in range(30)]
    seen = []
    monkeypatch.setattr(secrets.training_sequences, "__defaults__", (10,))
    monkeypatch.setattr(secrets.Field, "train", lambda self, data: seen.extend(data) or self)
    secrets.train_field(frame(spark, with_span + without))
    marked = [any(tags) for _, tags in seen]
    assert len(seen) == 20 and sum(marked) == 10


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()] + [(-5, None), (-6, ""), (-7, "x " * 9000)]
    pieces = packing.pack_documents(frame(spark, rows)).toPandas()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path(packing.WORD_BPE))
    import zlib
    at = {(r.doc_id, r.start): r for r in pieces.itertuples()}
    total = 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for s in range(0, len(ids), 2048):
            part = ids[s:s + 2048]
            r = at.pop((i, s))
            assert (r.length, r.doc_tokens) == (len(part), len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not at
    pieces = pieces.sort_values(["sequence_id", "offset"])
    assert ((pieces.groupby("sequence_id").length.cumsum() - pieces.length) == pieces.offset).all()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and len(sizes) <= 1.02 * total / 2048 + 2
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_path(bpe.BYTE_BPE))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows += [(-1 - k, x) for k, (_, x) in enumerate(EDGE)] + [(-99, "ab" * 3000 + " \x1c\x85 don't ſ")]
    want = dict(rows)
    for r in bpe.encode_documents(frame(spark, rows), texts=False).collect():
        ids = t.encode(want[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op1(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    right = (got.predicted == got.toxic).mean()
    assert right > 0.93 and got[got.toxic == 1].score.mean() > got[got.toxic == 0].score.mean() + 0.5
    edge = toxicity.score_documents(frame(spark, EDGE), labels, model=toxicity.Scorer(np.zeros(toxicity.BUCKETS), -2.0)).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == 0 for r in edge)
    assert toxicity.train([], []).scores([""])[0] < 0.7


def test_toxicity_reads_the_middle_of_long_words():
    """Unspaced text: a word in the middle enters the score, wherever it lies and in training too."""
    rng = random.Random(2)
    filler = lambda: "".join(rng.choice("aeioumnt") for _ in range(60))
    texts = [filler() + ("grukzwolp" if k % 2 else "selaminor") + filler() for k in range(200)]
    model = toxicity.train(texts, [k % 2 for k in range(200)])
    bad, good = (model.scores([filler() + w + filler() for _ in range(20)]) for w in ("grukzwolp", "selaminor"))
    assert bad.min() > good.max()
    _, a = toxicity.subword_buckets([b"a" * 50 + b"bcd" + b"a" * 50])
    _, b = toxicity.subword_buckets([b"a" * 103])
    assert len(a) == len(b) and set(a) - set(b)


def test_licenses(spark):
    a, b = list("xaybzcw"), list("abcw")
    assert [p for p in licenses.align([x.encode() for x in a], [x.encode() for x in b])] == [(1, 0), (3, 1), (5, 2), (6, 3)]
    notice = licenses.TEMPLATES["Apache-2.0-notice"]
    rows = [(1, f"some text. {notice} more text. {notice}"), (2, "nothing here"), (3, None), (4, licenses.TEMPLATES["MIT"].replace("copy", "kopy"))]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got[1].license == "Apache-2.0-notice" and got[1].n_found == 2 and got[1].coverage == 1.0
    assert got[2].license is None and got[3].n_found == 0
    assert got[4].license == "MIT" and 0.9 < got[4].coverage < 1
    assert len(licenses.increasing([3, 1, 2, 5, 4])) == 3


def test_licenses_tell_neighbours_apart():
    """A notice never counts for the license next to it: name and version decide."""
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for name, text in licenses.TEMPLATES.items():
        found = scan.find(f"some words before {text} and some behind")
        assert min(found, key=lambda x: (-x[3], x[1] - x[2]))[0] == name, name
    kinds = lambda t: {n for n, *_ in scan.find(t)}
    assert kinds("Released under the BSD License") == {"BSD-notice"}
    assert kinds("Licensed under the Mozilla Public License, Version 2.0") == {"MPL-2.0-notice"}
    assert kinds("Licensed under CC BY-SA 4.0") == {"CC-BY-SA-4.0-notice"}
    assert kinds("Licensed under CC BY 4.0") == {"CC-BY-4.0-notice"}
    assert kinds("Licensed under CC BY-NC-SA 4.0") == {"CC-BY-NC-SA-4.0-notice"}
    assert kinds(licenses.TEMPLATES["LGPL-3.0"]) == {"LGPL-3.0"} and kinds(licenses.TEMPLATES["GPL-2.0"]) == {"GPL-2.0"}
    assert kinds("Released under the Example License") == set()
    assert kinds("Licensed under the Apache License 2.0") == {"Apache-2.0-notice"}


def test_url_cascade(spark):
    rows = [(k, f"http://h{k % 40}.example.net/p?utm_source={k}" if k % 40 < 13 else f"http://h{k % 40}.example.net/p") for k in range(400)]
    rows += [(900, None), (901, "no scheme"), (902, "http://A.ORG/x"), (903, "http://example.org/en/12"), (903, "http://example.org/en/12"),
             (904, "http://org.com/de/"), (905, "x://h1.example.net")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("old"))
    got = url_filter.judge_urls(pages).collect()
    joined = url_filter.judge_urls(pages, max_bytes=0).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, joined)) and len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[k].verdict == ("block" if k % 40 < 13 else "allow") for k in range(400))
    assert (by[900].host, by[900].path, by[900].rule) == ("", "", None)
    assert (by[902].rule, by[902].verdict) == ("org/", "allow") and by[903].rule == "example.org/en/1"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first = P.quality(spark, docs, SF_SMALL)
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in quality.quality_rules(docs).filter("kept").collect())
    out = P.run(spark, SF_SMALL)
    assert out.columns[0] == "doc_id" and 0 < out.count()
    assert os.path.exists(P.__file__)


def test_chunk_tokenizer_equals_the_library_word_by_word():
    """Ends of chunks (letters, stops, marks, special tokens), over several calls and a cache that is emptied."""
    import random

    from tokenizers import Tokenizer

    from tickweave.llm.common import tokenizer_path
    from tickweave.llm.packing import WORD_BPE, ChunkTokenizer
    path, pick = tokenizer_path(WORD_BPE), random.Random(7)
    texts = ["", "a.", "A., b.", ".", "., . ,", "x,y. ", "<|endoftext|>. Foo. bar,", "It's. We'll, É. é, İ.", "9. a9, z..", "A.\nB,\r\nc.\x0bd"]
    texts += ["".join(pick.choice("aZ.,'s \n\té<|>9") for _ in range(30)) for _ in range(500)]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder = ChunkTokenizer(path)
    coder.cache.limit = 300
    got = [ids for i in range(0, len(texts), 50) for ids in coder.encode_batch(texts[i:i + 50])]
    assert got == want and coder.encode_batch(texts) == want
