"""Secret scans: pattern spans plus a linear-chain conditional random field (operator 7).

Three patterns give the base spans. A CRF then tags every token as secret begin, inside or outside and
adds spans the patterns miss (other key names, other shapes). Its features are the token's shape
(character classes, length, entropy, digit share), whether it touches the token before, the words before it,
on its line or the lines above, and features of the file (text) it is in; decoding is Viterbi over the sequence.

A sequence is a whole text, all its tokens. Scores are looked up per distinct token and summed for a text at
once. Where a token's score for outside beats whatever the tags around it could add, every best path has it
outside (:meth:`Tagger.possible`, a bound and no rule of thumb), so Viterbi steps through the other
tokens only and finds the path it would find over all of them.

The CRF is trained here, in numpy, on a bounded, documented sample: the base spans of at most ``TRAIN_ROWS``
texts serve as labels, with the pattern's own key words hidden from half of them, so that shape and context
must carry the decision. The sample takes texts in stretches of ``TRAIN_TOKENS`` tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import column_values, documents, map_arrow, text_chunks

#: Fixed patterns of the contract (bytes: the letters' cases are ASCII's).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # the maximal run, 20 or more characters
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN = 6

#: Tokens of the CRF (a run of non-ASCII bytes is one, so no span parts a character), and with the white space between.
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]+=*|[\x80-\xff]+|[^\sA-Za-z0-9+/_-]")
ITEM = re.compile(rb"[A-Za-z0-9+/_-]+=*|\s+|[\x80-\xff]+|[^\sA-Za-z0-9+/_-]")
SPACE = re.compile(rb"\s")
SIGNS = re.compile(rb"[^\sA-Za-z.,\x80-\xff]")
#: A token's shape: one sign for each run of lower case, upper case, digits or bytes beyond ASCII.
CLASSES = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else min(c, 128) for c in range(256))
RUNS = re.compile(rb"([aA9\x80])\1+")
TRAIN_ROWS, TRAIN_CHARS, TRAIN_SEQUENCES = 2000, 20_000, 4000
TRAIN_TOKENS, TRAIN_STRETCHES = 48, 4  # of a stretch, and of one text
VARIANTS = 6  # of a text with secrets, see :func:`varied`
SMALL, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
NAMES = ("password", "passwd", "pass", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "auth", "auth_token", "bearer",
         "credential", "credentials", "client_secret", "signing_key", "encryption_key", "login")
MARKS = (": ", ":", "=", " = ", ' = "', '="', ': "', '": "', " = '", ": '", "\n", " ", ":\n")
N_FEATURES, N_TAGS, EPOCHS, RATE, L2 = 1 << 15, 3, 60, 0.1, 1e-4
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, leftmost non-overlapping per kind, failing matches dropped."""
    spans = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(raw)]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(raw)]
    return spans


def entropy(run: bytes) -> float:
    n = len(run)
    return math.log2(n) - sum(c * math.log2(c) for c in map(run.count, set(run))) / n


def is_candidate(run: bytes) -> bool:
    """Digits together with letters, or long runs of mixed case: what words hardly ever are."""
    digit = any(48 <= c <= 57 for c in run)
    upper, lower = any(65 <= c <= 90 for c in run), any(97 <= c <= 122 for c in run)
    return (digit and (upper or lower)) or (len(run) >= 20 and upper and lower and run[1:-1].lower() != run[1:-1])


def sequences(raw: bytes) -> list[list[tuple[int, int]]]:
    """Token spans of the text's sequence, that of all its tokens; none without a token."""
    spans = [t.span() for t in TOKEN.finditer(raw)]
    return [spans] if spans else []


def file_features(raw: bytes) -> list[str]:
    """Of the whole text: its size, and how much of it looks like code or settings."""
    marks = sum(raw.count(c) for c in (b"=", b"{", b"}", b";", b":", b'"'))
    return [f"file-size{min(6, len(raw).bit_length() // 3)}", f"file-code{min(4, int(200 * marks / (len(raw) + 1)))}"]


def shape_features(tok: bytes) -> list[str]:
    shape = RUNS.sub(rb"\1", tok.translate(CLASSES))[:6]
    n = len(tok)
    out = [f"shape{shape!r}", f"len{min(10, n // 4)}"]
    if n >= 12 and is_candidate(tok):
        digits = sum(48 <= c <= 57 for c in tok)
        out += [f"candidate", f"entropy{int(2 * entropy(tok))}", f"digits{5 * digits // n}"]
        if re.fullmatch(rb"[0-9a-f]+", tok):
            out.append("hexlike")
        if re.fullmatch(rb"[A-Z0-9]+", tok):
            out.append("caps")
    return out


@lru_cache(1 << 16)
def bucket(name: str) -> int:
    return crc32(name.encode()) % N_FEATURES


def word_feature(tok: bytes) -> str:
    return f"before{tok.lower()[:12]!r}"


HEAD = crc32(b"beforeb'")


def mark_feature(tok: bytes) -> str:
    return f"mark{tok[:1]!r}"


def next_feature(tok: bytes) -> str:
    return "next-word" if tok[:1].isalnum() else f"next{tok[:1]!r}"


def token_features(raw: bytes, spans: list[tuple[int, int]], hide: bool = False, ahead: list[str] | None = None) -> list[list[int]]:
    """Feature numbers of each token of one sequence. ``hide`` drops neighbouring words; ``ahead`` are the file's."""
    toks = [raw[a:b] for a, b in spans]
    ahead = file_features(raw) if ahead is None else ahead
    out = []
    for i, tok in enumerate(toks):
        names = ["bias", *shape_features(tok), *ahead]
        names.append("touches" if i and spans[i - 1][1] == spans[i][0] else "apart")
        if not hide:
            words = [t for t in toks[max(0, i - 4):i] if t[:1].isalpha()]
            names += [word_feature(w) for w in words[-2:]]
            names.append(mark_feature(toks[i - 1]) if i else "first")
            names.append(next_feature(toks[i + 1]) if i + 1 < len(toks) else "next-word")
        out.append([bucket(x) for x in names])
    return out


def values(raw: bytes) -> list[tuple[int, int]]:
    """The values of the base spans."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return found + [(a, b) for k, a, b in base_spans(raw) if k]


def span_tags(raw: bytes, spans: list[tuple[int, int]], found: list[tuple[int, int]] | None = None) -> list[int]:
    """Labels: the first token of a value is BEGIN, the others are INSIDE. Weak ones by default, of the base spans."""
    found = values(raw) if found is None else found
    tags = []
    for a, b in spans:
        hit = [v for v in found if v[0] <= a and b <= v[1]]
        tags.append(OUT if not hit else BEGIN if any(v[0] == a for v in hit) else INSIDE)
    return tags


def drawn_value(rng: random.Random) -> str:
    """A made-up secret: letters and digits, hexadecimal, short, words joined, or with signs among it."""
    kind = rng.randrange(5)
    if kind == 3:
        words = ["".join(rng.choice(SMALL) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(3, 5))]
        return rng.choice("-_.").join(words) + rng.choice(["", str(rng.randrange(100))])
    signs, least, most = ((SMALL + SMALL.upper() + DIGITS, 16, 44), ("abcdef" + DIGITS, 16, 64), (SMALL + DIGITS, 6, 12), None,
                          (SMALL + SMALL.upper() + DIGITS * 2 + "!$%#@&*^?~", 8, 20))[kind]
    while True:
        value = "".join(rng.choice(signs) for _ in range(rng.randint(least, most)))
        if value[0].isalnum() and any(c in DIGITS for c in value) and any(c not in DIGITS for c in value):
            return value


def varied(raw: bytes, rng: random.Random) -> tuple[bytes, list[tuple[int, int]]]:
    """The text with its secrets drawn anew, under other names and marks, and where they lie then: labels for the
    shapes and surroundings that the base patterns do not have."""
    whole = [(m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out, found, at, size = [], [], 0, 0
    for a, b in sorted(whole + [(a, b) for k, a, b in base_spans(raw) if k and not any(c <= a and b <= d for c, d in whole)]):
        if a < at:
            continue
        name = rng.choice([rng.choice(NAMES), "".join(rng.choice(SMALL) for _ in range(rng.randint(3, 9))) + rng.choice(["", "_key", "_hash", "_id"])])
        head = raw[at:a] + (name + rng.choice(MARKS)).encode() if (a, b) in whole else raw[at:a]
        value = drawn_value(rng).encode()
        out += [head, value]
        found.append((size + len(head), size + len(head) + len(value)))
        size, at = found[-1][1], b
    return b"".join([*out, raw[at:]]), found


# --- the field ----------------------------------------------------------------------------------

class Field:
    """Weights of the CRF: emission (features x tags) and transitions (tags x tags)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, N_TAGS)) if emit is None else emit
        self.move = np.zeros((N_TAGS, N_TAGS)) if move is None else move

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.stack([self.emit[f].sum(axis=0) for f in feats])

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        s = self.scores(feats)
        best, back = s[0].copy(), []
        best[INSIDE] = -1e9  # nothing to be inside of
        move = self.move.copy()
        move[OUT, INSIDE] = -1e9
        for row in s[1:]:
            via = best[:, None] + move
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def train(self, data: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Field:
        """Batch AdaGrad on the log likelihood, forward-backward over padded sequences. Elementwise
        numpy only, deterministic."""
        if not data:
            return self
        data = sorted(data, key=lambda d: len(d[0]))
        packed = []
        for part in (data[i:i + 256] for i in range(0, len(data), 256)):
            n, length = len(part), max(len(f) for f, _ in part)
            row = np.array([i * length + t for i, (f, _) in enumerate(part) for t, fs in enumerate(f) for _ in fs], np.int32)
            col = np.array([x for f, _ in part for fs in f for x in fs], np.int16)
            live = np.arange(length)[None, :] < np.array([len(f) for f, _ in part])[:, None]
            gold, steps = np.zeros((n, length, N_TAGS)), np.zeros((N_TAGS, N_TAGS))
            for i, (_, y) in enumerate(part):
                gold[i, np.arange(len(y)), y] = 1.0
                np.add.at(steps, (y[:-1], y[1:]), 1.0)
            packed.append((row, col, live, gold, steps))
        sum_emit, sum_move = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(epochs):
            for row, col, live, gold, steps in packed:
                n, length, _ = gold.shape
                s = np.stack([np.bincount(row, weights=self.emit[col, k], minlength=n * length) for k in range(N_TAGS)], axis=1)
                prob, pairs = marginals(s.reshape(n, length, N_TAGS), self.move, live)
                diff = (gold - prob).reshape(-1, N_TAGS) / n
                grad = np.stack([np.bincount(col, weights=diff[row, k], minlength=N_FEATURES) for k in range(N_TAGS)], axis=1)
                grad -= L2 * self.emit
                move = (steps - pairs) / n - L2 * self.move
                sum_emit += grad**2
                sum_move += move**2
                self.emit += RATE * grad / np.sqrt(sum_emit)
                self.move += RATE * move / np.sqrt(sum_move)
        return self


def marginals(s: np.ndarray, move: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences of scores (rows x tokens x tags): the probability of each tag at each ``live`` token, and
    the expected number of each step from tag to tag. Forward and backward sums are scaled to 1 at each token."""
    e, step = np.exp(s - s.max(axis=2, keepdims=True)), np.exp(move - move.max())
    e[~live] = 1.0
    ahead, back, size = np.empty_like(e), np.ones_like(e), np.ones(e.shape[:2])
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, e.shape[1]):
        a = (ahead[:, t - 1, :, None] * step).sum(axis=1) * e[:, t]
        size[:, t] = a.sum(axis=1)
        ahead[:, t] = a / size[:, t, None]
    for t in range(e.shape[1] - 2, -1, -1):
        b = (step * (e[:, t + 1] * back[:, t + 1])[:, None, :]).sum(axis=2) / size[:, t + 1, None]
        back[:, t] = np.where(live[:, t + 1, None], b, 1.0)
    both = ahead[:, :-1, :, None] * step * ((e * back)[:, 1:] / size[:, 1:, None])[:, :, None, :]
    return ahead * back * live[:, :, None], (both * live[:, 1:, None, None]).sum(axis=(0, 1))


def train_field(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Field:
    """Fit the field on the base spans of at most ``rows`` texts of at most ``chars`` characters that
    hold one, smallest text hash first, and as many texts without (their tokens are outside). Each
    class has its own bound of TRAIN_SEQUENCES, so neither crowds out the other as the input grows. The least hashes are
    found first, without their texts."""
    spark = docs.sparkSession
    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).filter(F.length("t").between(1, chars))
    low = F.lower("t")  # what holds none of the words needs no pattern
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    has = (word & F.col("t").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")) \
        | F.col("t").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    some = text.select("t", F.xxhash64("t").alias("h"))
    data: list = []
    for flag in (True, False):
        least = {r["h"] for r in some.filter(has == flag).select("h").orderBy("h").limit(rows).collect()}
        hashes = spark.createDataFrame([(h,) for h in least], "h long")
        got = some.join(F.broadcast(hashes), "h").orderBy("h", "t").limit(rows)
        data += training_sequences(r["t"].encode("utf-8", "replace") for r in got.toLocalIterator())
    return Field().train(data)


def training_sequences(texts: Iterable[bytes], limit: int = TRAIN_SEQUENCES) -> list[tuple[list[list[int]], list[int]]]:
    """(features, tags) of the first ``limit`` stretches of one class of texts. Of a text with secrets the stretches
    that hold one, else those with the most digits and signs, which are easiest to take for one; at most TRAIN_STRETCHES."""
    data: list = []
    rng = random.Random(7)
    for text in texts:
        found = values(text)
        forms = [(text, found), *(varied(text, rng) for _ in range(VARIANTS if found else 0))]
        for raw, found in forms:
            for spans in sequences(raw):
                tags = span_tags(raw, spans, found)
                cuts = [(i, i + TRAIN_TOKENS) for i in range(0, len(spans), TRAIN_TOKENS)]
                signs = lambda c: len(SIGNS.findall(raw, spans[c[0]][0], spans[min(c[1], len(spans)) - 1][1]))  # noqa: B023,E731
                cuts = [c for c in cuts if any(tags[slice(*c)])] or sorted(cuts, key=signs, reverse=True)
                ahead = file_features(raw)
                for a, b in cuts[:TRAIN_STRETCHES]:
                    if len(data) >= limit:
                        return data
                    hide = len(data) % 2 == 1  # every other sequence must do without the words around it
                    near = token_features(raw, spans[max(0, a - 4):b + 1], hide, ahead)
                    lead = min(a, 4)
                    data.append((near[lead:lead + len(tags[a:b])], tags[a:b]))
    return data


class Tagger:
    """Viterbi over all tokens of a text, with the scores of each distinct token kept between texts. Scores are those
    of BEGIN and INSIDE less that of OUT, which leaves every comparison of paths as it is."""

    KEEP, STEP = 200_000, 1 << 16

    def __init__(self, field: Field):
        self.emit, self.move = field.emit[:, 1:] - field.emit[:, :1], field.move
        self.bounds = self._bounds(field.move)
        one = [bytes([c]) for c in range(256)]
        self.space, self.letter = (np.array([f(c) for c in one]) for f in (bytes.isspace, bytes.isalpha))
        self.marks, self.nexts = (np.array([self.emit[bucket(f(c))] for c in one]) for f in (mark_feature, next_feature))
        self.first, self.touches, self.apart, self.next_word = (self.emit[bucket(x)] for x in ("first", "touches", "apart", "next-word"))
        self.shapes: dict = {}
        self._forget()

    def _forget(self) -> None:
        self.ids, self.known = _Ids(), 0
        #: by distinct item: its own scores, those it gives as a word before; first byte, length, no white space
        self.own, self.word = np.zeros((1024, 2)), np.zeros((1024, 2))
        self.byte, self.size, self.real = np.zeros(1024, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, bool)

    def _own(self, item: bytes) -> np.ndarray:
        """The scores of a token's shape; most tokens share theirs."""
        small = item.isalpha() and item.islower()  # most words
        key = b"a" if small else RUNS.sub(rb"\1", item.translate(CLASSES))[:6], min(10, len(item) // 4)
        plain = small or len(item) < 12 or not is_candidate(item)
        if plain and key in self.shapes:
            return self.shapes[key]
        found = self.emit[[bucket(x) for x in ("bias", *shape_features(item))]].sum(axis=0)
        if plain and len(self.shapes) < self.KEEP:
            self.shapes[key] = found
        return found

    def _learn(self) -> None:
        """Fill the tables for the items that came up since the last time."""
        new, a = self.ids.new, self.known
        b = self.known = a + len(new)
        if b > len(self.byte):
            for name in ("own", "word", "byte", "size", "real"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros((2 * b - len(old), *old.shape[1:]), old.dtype)]))
        byte = np.array([x[0] for x in new], np.uint8)
        self.byte[a:b], self.size[a:b], self.real[a:b] = byte, [len(x) for x in new], ~self.space[byte]
        none = np.zeros(2)
        self.own[a:b] = [self._own(x) if real else none for x, real in zip(new, self.real[a:b].tolist())]
        words = np.flatnonzero(self.letter[byte])
        # bucket(word_feature(x)): such an item holds nothing that repr() would change
        self.word[a + words] = self.emit[[crc32(b"'", crc32(new[i][:12].lower(), HEAD)) % N_FEATURES for i in words.tolist()]]
        self.ids.new = []

    def tokens(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """(id, start, end, touches the one before) of every token, read some bytes at a time."""
        if len(self.ids) > self.KEEP:
            self._forget()
        parts, at = [], 0
        while at < len(raw):
            cut = SPACE.search(raw, at + (1 << 18))  # no token holds white space
            items = ITEM.findall(raw, at, cut.end() if cut else len(raw))
            ids = np.fromiter(map(self.ids.__getitem__, items), np.int32, len(items))
            if self.ids.new:
                self._learn()
            size = self.size[ids]
            ends = at + np.cumsum(size)
            real = self.real[ids]
            touch = real.copy()
            touch[0], touch[1:] = False, real[1:] & real[:-1]
            parts.append((ids[real], (ends - size)[real], ends[real], touch[real]))
            at = int(ends[-1])
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 4

    def scores(self, ids: np.ndarray, touch: np.ndarray, ahead: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of tokens ``a`` to ``b``; ``ahead`` are the file's."""
        s = self.own[ids[a:b]]
        s += ahead
        s += np.where(touch[a:b, None], self.touches, self.apart)
        near = ids[max(0, a - 4):min(len(ids), b + 1)]
        lead, byte = a - max(0, a - 4), self.byte[near]
        letter = self.letter[byte]
        # the last two words of the four tokens before: words are numbered, two places of none ahead of them
        places = np.concatenate([[-9, -9], np.flatnonzero(letter)])
        at = np.arange(lead, lead + b - a)
        count = np.cumsum(letter)[lead:lead + b - a] - letter[lead:lead + b - a]
        for k in (0, 1):
            place = places[count + k]
            hit = np.flatnonzero(at - place <= 4)
            s[hit] += self.word[near[place[hit]]]
        s[1 if a == 0 else 0:] += self.marks[byte[max(0, lead - 1):lead + b - a - 1]]
        if a == 0:
            s[0] += self.first
        s[:len(byte) - lead - 1] += self.nexts[byte[lead + 1:lead + 1 + b - a]]
        if b == len(ids):
            s[-1] += self.next_word
        return s

    @staticmethod
    def _bounds(move: np.ndarray) -> tuple[float, ...]:
        """The most that the steps around a secret can add over the same path with its tokens outside: into its first
        token, out of it as a single one, out of its last, and into its rest; and each further step within it."""
        step = lambda i, j: 0.0 if i is None or j is None else float(move[i, j])  # noqa: E731  None: the text's start or end
        into = max(step(i, BEGIN) - step(i, OUT) for i in (None, OUT, BEGIN, INSIDE))
        out_one, out = (max(step(k, j) - step(OUT, j) for j in (None, OUT, BEGIN)) for k in (BEGIN, INSIDE))
        rest = max(step(k, INSIDE) - step(k, OUT) for k in (BEGIN, INSIDE))
        return into, out_one, out, rest, step(BEGIN, INSIDE) - step(OUT, OUT), step(INSIDE, INSIDE) - step(OUT, OUT)

    def possible(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every token, whether some best path could begin a secret there, and whether one could have it inside.
        Putting a whole secret outside, or a secret's rest from a token on, leaves a legal path; where that gains
        however far the secret would reach, no best path has it."""
        into, out_one, out, rest, second, further = self.bounds
        gain = s[:, 1] + further
        sums = np.cumsum(gain)
        reach = np.maximum.accumulate(sums[::-1])[::-1] - sums + gain - further  # the most that tokens from here on add as inside ones
        begin = s[:, 0] + into + np.maximum(out_one, second + out + np.append(reach[1:], -np.inf))
        return begin > -1e-6, reach + rest + out > -1e-6

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(kind, start, end) in bytes of the secrets on the best path."""
        ids, start, end, touch = self.tokens(raw)
        n = len(ids)
        if not n:
            return []
        ahead = self.emit[[bucket(x) for x in file_features(raw)]].sum(axis=0)
        s = np.concatenate([self.scores(ids, touch, ahead, a, min(n, a + self.STEP)) for a in range(0, n, self.STEP)])
        begin, inside = self.possible(s)
        either, out, i = begin | inside, [], 0
        for first in np.flatnonzero(begin).tolist():
            if first < i:
                continue
            i = first + 1
            while i < n and either[i]:
                i += 1
            tags = best_tags([[0.0, x, y] for x, y in s[first:i].tolist()], self.move, first == 0, i == n)
            for k in (k for k, tag in enumerate(tags) if tag == BEGIN):
                last = k
                while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                    last += 1
                out.append((3, int(start[first + k]), int(end[first + last])))
        return out


class _Ids(dict):
    """Numbers of distinct items in order of their first look-up, and the ``new`` ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, item: bytes) -> int:
        i = self[item] = len(self)
        self.new.append(item)
        return i


def best_tags(scores: list[list[float]], move: np.ndarray, starts: bool, ends: bool) -> list[int]:
    """Viterbi over tokens between others that are outside, or the text's start or end."""
    m = [[float(x) for x in row] for row in move]
    m[OUT][INSIDE] = -1e9  # nothing to be inside of
    best = [x + (0.0 if starts else step) for x, step in zip(scores[0], m[OUT])]
    best[INSIDE] = -1e9
    back = []
    for s in scores[1:]:
        via = [max(range(N_TAGS), key=lambda i: best[i] + m[i][j]) for j in range(N_TAGS)]  # noqa: B023
        best = [best[via[j]] + m[via[j]][j] + s[j] for j in range(N_TAGS)]
        back.append(via)
    tags = [max(range(N_TAGS), key=lambda i: best[i] + (0.0 if ends else m[i][OUT]))]
    for via in reversed(back):
        tags.append(via[tags[-1]])
    return tags[::-1]


def crf_spans(raw: bytes, field: Field | Tagger) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the secrets that Viterbi finds."""
    return (field if isinstance(field, Tagger) else Tagger(field)).spans(raw)


def code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code-point offsets, sorted by start, then kind."""
    if not raw.isascii():
        at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        count = lambda b: int(at[b - 1]) if b else 0
        spans = [(k, count(a), count(b)) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_secrets(raw: bytes, field: Field | Tagger) -> tuple[list, list]:
    """(base spans, all spans) in code points. A CRF span that lies in a base span adds nothing."""
    base = base_spans(raw)
    added = [s for s in crf_spans(raw, field) if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
    return code_points(raw, base), code_points(raw, base + added)


REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: counts of base spans per kind, their digest, and all spans
    (``kind:start:end`` in code points, end exclusive). Null text is empty and has none; repeated rows
    each get their row; other columns are not read."""
    field = field or train_field(docs, text_col)
    emit, move = field.emit, field.move  # 0.8 MB, whatever the corpus
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa
        model = Tagger(Field(emit, move))
        for batch in batches:
            for start, part in text_chunks(batch.column(1).to_pylist()):
                found = [find_secrets(t.encode("utf-8", "replace"), model) for t in part]
                counts = [[sum(k == kind for k, _, _ in every) for _, every in found] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), *(pa.array(c, pa.int64()) for c in counts[:3]),
                     pa.array([hashlib.sha256(digest_text(b).encode()).hexdigest() for b, _ in found]),
                     pa.array([digest_text(every) for _, every in found]), pa.array(counts[3], pa.int64())],
                    ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, {REPORT}").withColumnRenamed("id", id_col)


def mask(raw: bytes, spans: list[tuple[int, int, int]], mark: bytes = b"[SECRET]") -> bytes:
    """The text with every span (bytes) replaced; overlapping spans are one."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [raw[at:a], mark]
        at = b
    return b"".join([*out, raw[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The input's columns with every secret in ``text_col`` masked; null stays null, all rows stay."""
    field = field or train_field(docs, text_col)
    emit, move = field.emit, field.move
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        import pyarrow as pa
        model = Tagger(Field(emit, move))
        for batch in batches:
            texts = []
            for t in column_values(batch.column(at)):
                raw = (t or "").encode("utf-8", "replace")
                spans = base_spans(raw) + crf_spans(raw, model) if raw else []
                texts.append(mask(raw, spans).decode() if spans else t)
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
