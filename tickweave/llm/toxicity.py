"""Toxicity by subword-bag embeddings and a linear softmax (operator 1).

A word is the bag of its character n-grams (3 to 5, with word ends marked) and itself, hashed into
``BUCKETS`` embedding rows; a text is the mean of its words' means; a linear layer and a softmax over
(clean, toxic) give the score. Embeddings and layer are trained jointly in numpy on a bounded sample
of labelled rows, so a misspelt or unseen word is scored through the n-grams it shares.

Because everything up to the softmax is linear, a trained model folds into one number per bucket
(its embedding against the difference of the two output rows): a word costs a few look-ups and a text
one mean. Texts are scored whole and where they lie; nothing is shuffled but the sample's labels.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import BoundedCache, documents, map_arrow, per_process, text_chunks
from tickweave.sources.tables import read_table

BUCKETS, DIM, NGRAMS = 1 << 16, 8, (3, 4, 5)
SCALE = 20.0
EPOCHS, RATE, L2 = 100, 0.05, 1e-5
#: Bound of the training sample: toxic rows, clean rows for each of those (smallest hash of text
#: first), and characters per row.
TRAIN_ROWS, CLEAN_PER_TOXIC, TRAIN_CHARS = 2000, 3, 20_000
THRESHOLD = 0.7
WORDS_AT_ONCE = 50_000
FOLDS, HELD_OUT = 3, 1
STRIP = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"""


def words_of(text: str) -> list[bytes]:
    """White-space words, A-Z lower-cased; :func:`subword_buckets` strips their marks."""
    return text.encode("utf-8", "replace").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift) over an array."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


#: Odd multipliers of the places of a word (longer words take them again) and of an n-gram's length.
PLACES = mixed(np.arange(1, 43, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def subword_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): one entry per character n-gram of each word, plus one for the word itself; owner is
    the word's index. A word without a letter has none. Words run through one code-point array, so the
    n-grams of all are hashed at once."""
    bare = []
    for word in words:
        w = word.strip(STRIP).decode("utf-8", "replace")
        bare.append(f"<{w}>" if w else "")
    length = np.fromiter(map(len, bare), np.int64, len(bare))
    if not length.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(bare).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    end = np.cumsum(length)
    of = np.repeat(np.arange(len(bare)), length)
    left = np.repeat(end, length) - np.arange(len(code))  # characters of the word from here on
    owners, buckets = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += code[at + k] * PLACES[k]
        owners.append(of[at])
        buckets.append(mixed(h) % np.uint64(BUCKETS))
    some = np.flatnonzero(length)
    place = np.arange(len(code)) - np.repeat(end - length, length)
    owners.append(some)
    buckets.append(mixed(np.add.reduceat(code * PLACES[place % len(PLACES)], (end - length)[some])) % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


class Scorer:
    """A trained model folded to one value per bucket."""

    def __init__(self, bucket_value: np.ndarray, bias: float):
        self.value, self.bias = bucket_value, bias
        self.cache = BoundedCache(600_000)

    def scores(self, texts: list[str]) -> np.ndarray:
        lines = [words_of(t) for t in texts]
        words = set().union(*lines)
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > self.cache.limit:
            self.cache.clear()
            new = words
        new = list(new)
        for first in range(0, len(new), WORDS_AT_ONCE):
            some = new[first:first + WORDS_AT_ONCE]
            owner, bucket = subword_buckets(some)
            size = np.bincount(owner, minlength=len(some))
            total = np.bincount(owner, weights=self.value[bucket], minlength=len(some))
            self.cache.update(zip(some, (total / np.maximum(size, 1)).tolist(), strict=True))
        n = np.array([len(x) for x in lines], np.int64)
        values = np.fromiter((v for x in lines for v in map(self.cache.__getitem__, x)), float, int(n.sum()))
        mean = np.bincount(np.repeat(np.arange(len(lines)), n), weights=values, minlength=len(lines)) / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + SCALE * mean, -60, 60)))


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 1) -> Scorer:
    """Joint training of embeddings and softmax layer by full-batch Adam, classes weighed alike.
    Elementwise numpy only and seeded: the same sample gives the same model."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, float)
    vocab: dict[bytes, int] = {}
    rows, cols, counts, sizes = [], [], [], []
    for i, t in enumerate(texts):
        bag: dict[int, int] = {}
        ws = words_of(t)
        for w in ws:
            k = vocab.setdefault(w, len(vocab))
            bag[k] = bag.get(k, 0) + 1
        rows += [i] * len(bag)
        cols += bag.keys()
        counts += bag.values()
        sizes.append(max(1, len(ws)))
    if not vocab or len(set(toxic)) < 2:  # nothing to tell apart: the share of toxic rows, if any
        share = float(y.mean()) if len(y) else 0.0
        return Scorer(np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rows, cols = np.array(rows, np.int32), np.array(cols, np.int32)
    part = (np.array(counts) / np.array(sizes)[rows]).astype(np.float32)
    words, owners, buckets = list(vocab), [], []
    for first in range(0, len(words), WORDS_AT_ONCE):
        of, b = subword_buckets(words[first:first + WORDS_AT_ONCE])
        owners.append((of + first).astype(np.int32))
        buckets.append(b.astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    size = np.bincount(owner, minlength=len(words))
    each = (1.0 / np.maximum(size, 1))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for turn in range(1, epochs + 1):
        embed, layer, bias = params
        diff = layer[:, 1] - layer[:, 0]
        value = (embed * diff).sum(axis=1)
        word = np.bincount(owner, weights=value[bucket], minlength=len(size)) * each
        logit = SCALE * np.bincount(rows, weights=part * word[cols], minlength=len(y)) + bias[1] - bias[0]
        err = (1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))) - y) * weight
        back_word = SCALE * np.bincount(cols, weights=part * err[rows], minlength=len(size)) * each
        back = np.bincount(bucket, weights=back_word[owner], minlength=BUCKETS)
        of_diff = (embed * back[:, None]).sum(axis=0)
        grads = [back[:, None] * diff + L2 * embed, np.stack([-of_diff, of_diff], axis=1) + L2 * layer,
                 np.array([-err.sum(), err.sum()])]
        for p, g, (m, v) in zip(params, grads, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    embed, layer, bias = params
    return Scorer((embed * (layer[:, 1] - layer[:, 0])).sum(axis=1), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """(texts, toxic) of at most ``rows`` toxic and ``CLEAN_PER_TOXIC * rows`` clean rows outside the
    held-out fold, texts of at most ``chars`` characters, smallest text hash first. Only the sample's ids meet the texts twice."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    text = docs.select("doc_id", F.col("text").cast("string").alias("t")).filter(F.length("t").between(1, chars))
    ids = text.select("doc_id", F.xxhash64("t").alias("h")).join(known, "doc_id")
    picked = [r for k in (0, 1) for r in
              ids.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(rows if k else rows * CLEAN_PER_TOXIC).collect()]  # ids only, bounded
    toxic = {r["doc_id"]: r["toxic"] for r in picked}
    if not toxic:
        return [], []
    got = {(r["doc_id"], r["t"]) for r in text.filter(F.col("doc_id").isin(list(toxic))).toLocalIterator()}
    got = sorted(got)
    return [t for _, t in got], [toxic[i] for i, _ in got]


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Scorer | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row. Null and empty texts get the model's
    bias as their score; null ids are not held out. Neither labels, lang, source nor the id enter a
    score; other columns are not read."""
    model = model or train(*training_sample(docs, labels))
    value, bias = model.value.astype(np.float32), model.bias  # 256 kB, whatever the corpus
    key = ("toxicity", zlib.crc32(value.tobytes()), bias)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa
        scorer = per_process(key, lambda: Scorer(value.astype(float), bias))
        for batch in batches:
            for start, part in text_chunks(batch.column(2).to_pylist()):
                score = scorer.scores(part)
                some = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
