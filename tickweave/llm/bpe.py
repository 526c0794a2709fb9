"""Byte-level BPE encoding and decoding (operator 9) by contiguous rank arrays.

A short word is held as its parts' ids side by side plus an equally contiguous array with the merge
rank of each adjacent pair. Encoding repeats: scan the ranks for the minimum (the leftmost of equal
ones), delete the boundary there, and refresh the ranks of the two neighbouring pairs, until no
adjacent pair has a rank. Words of one length are worked on together as the rows of a matrix: every
unfinished row loses exactly one boundary per round, so the arrays stay rectangular and contiguous.
Words beyond ``SHORT`` bytes (rare; a scan per merge would be quadratic) take a heap over a linked
list, with the same order of merges.

The work is per text, so Spark deals rows to tasks and nothing is shuffled. A worker keeps a bounded
cache from word to ids; it only saves time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import BoundedCache, documents, map_arrow, per_process, text_chunks, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
SHORT = 64
NO_RANK = np.int32(2**31 - 1)
CACHE_WORDS = 400_000
#: Letters, numbers and white space among the first 256 code points, as character classes.
LATIN = (r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")


def byte_chars() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the other bytes
    take the code points from 256 on, in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder of a byte-level BPE file (vocabulary, ordered merges, added tokens)."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.pattern = pattern or public_tokenizers.PATTERN
        self.split_any = regex.compile(self.pattern).findall
        self.split_latin = re.compile(self.latin_pattern()).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        added = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.added_re = regex.compile("(" + "|".join(added) + ")") if added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        for content, i in self.added.items():
            self.token_bytes[i] = content.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.ranks = {int(k): int(r) for k, r in zip(keys, range(len(keys)), strict=True)}
        self.cache = BoundedCache(CACHE_WORDS)

    def latin_pattern(self) -> str:
        """The split pattern for texts of code points below 256, where its classes are short lists and
        the plain regular-expression engine (twice as fast) takes them."""
        letters, numbers, blanks = LATIN
        return (self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
                .replace(r"(?!\S)", f"(?![^{blanks}])").replace(r"\s", f"[{blanks}]")
                .replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))

    def split(self, text: str) -> list[str]:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def encode_block(self, words: list[bytes]) -> list[bytes]:
        """The packed ids (little-endian uint32) of words that all have the same length."""
        n, length = len(words), len(words[0])
        parts = self.byte_id[np.frombuffer(b"".join(words), np.uint8).reshape(n, length)]
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            done = low == NO_RANK
            if done.any():
                whole = parts[done].astype("<u4")
                for r, ids in zip(rows[done].tolist(), whole, strict=True):
                    out[r] = ids.tobytes()
                if done.all():
                    return out
                go = ~done
                rows, parts, ranks, at, low = rows[go], parts[go], ranks[go], at[go], low[go]
            m, width = parts.shape
            line = np.arange(m)
            parts[line, at] = self.merged[low]
            keep = np.arange(width)[None, :] != (at + 1)[:, None]
            parts = parts[keep].reshape(m, width - 1)
            # deleting the boundary drops the merged pair's rank; its neighbours are refreshed
            keep = np.arange(width - 1)[None, :] != at[:, None]
            ranks = ranks[keep].reshape(m, width - 2)
            if width > 2:
                left = at > 0
                ranks[line[left], at[left] - 1] = self.pair_ranks(parts[line[left], at[left] - 1], parts[line[left], at[left]])
                right = at < width - 2
                ranks[line[right], at[right]] = self.pair_ranks(parts[line[right], at[right]], parts[line[right], at[right] + 1])

    def encode_long(self, word: bytes) -> bytes:
        """One long word: a heap of (rank, position) over linked parts."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size, ranks = self.size, self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := ranks.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            p = before[i]
            if p >= 0 and (q := ranks.get(ids[p] * size + ids[i])) is not None:
                heapq.heappush(heap, (q, p, ids[p], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache does not hold."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > self.cache.limit:
            self.cache.clear()
            new = words
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                self.cache[w] = self.encode_long(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            if length:
                ids = self.encode_block([raw for _, raw in group])
                self.cache.update(zip((w for w, _ in group), ids, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; added tokens found in a text keep their own id."""
        pieces, words = [], set()
        for t in texts:
            if self.added_re is not None and any(a in t for a in self.added):
                line: list = []
                for i, s in enumerate(self.added_re.split(t)):
                    line += [self.added[s]] if i % 2 else self.split(s)
            else:
                line = self.split(t)
            pieces.append(line)
            words.update(line)
        self.learn(words.difference(self.added.values()))
        get = self.cache.__getitem__
        out = []
        for line in pieces:
            try:
                out.append(b"".join(map(get, line)))
            except KeyError:  # an added token's id among the words
                out.append(b"".join(x.to_bytes(4, "little") if x.__class__ is int else get(x) for x in line))
        return out

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def bpe(path: str | None) -> RankArrayBPE:
    path = path or tokenizer_path(BYTE_BPE)
    return per_process(("bpe", path), lambda: RankArrayBPE(path))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     texts: bool = True) -> DataFrame:
    """(id, ids binary, decoded): packed little-endian uint32 ids of each whole text and their decoded
    text; with ``texts=False`` their digests (n_tokens, ids_sha256, decoded_sha256) instead. Null text
    counts as empty (no ids). One row per input row; other columns are not read. ``path`` is the
    vocabulary file on every machine (default: the installed public file)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = f"id {dict(rows.dtypes)['id']}, " + ("ids binary, decoded string" if texts else
                                                 "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        import pyarrow as pa
        coder = bpe(path)
        for batch in batches:
            ids = batch.column(0)
            for start, part in text_chunks(batch.column(1).to_pylist()):
                packed = coder.encode_batch(part)
                some = ids.slice(start, len(part))
                if texts:
                    cols = [pa.array(packed, pa.binary()), pa.array(map(coder.decode, packed), pa.string())]
                    names = ["id", "ids", "decoded"]
                else:
                    cols = [pa.array([len(p) // 4 for p in packed], pa.int64()),
                            pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                            pa.array([hashlib.sha256(coder.decode(p).encode()).hexdigest() for p in packed])]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([some, *cols], names)

    out = map_arrow(rows, run, schema)
    return out.withColumnRenamed("id", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), texts=False)
