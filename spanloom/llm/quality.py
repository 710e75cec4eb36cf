"""Quality rules: counts over whole texts, and a calibrated text classifier.

The classifier is a logistic regression on hashed words and hashed character
n-grams, fitted on a bounded sample of labelled rows and calibrated on rows it
was not fitted on. Texts are scored in Arrow batches with vectorised hashing;
only lines and windows whose hash occurs twice in a text are looked at singly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import chunks, joined

# Labelled rows to learn from, at most so many of each label.
TRAIN_ROWS = 1_500
SEED = 23
BUCKETS = 1 << 17
GRAM = 4  # bytes of a character n-gram
THRESHOLD = 0.5
CHUNK = 1 << 20  # bytes of text handled at once: arrays take about a hundred times that
MIN_WORDS = 10
WINDOW = 5  # words
MAX_REPEATED = (20, 100)  # repeated words, as a share of all words
SYMBOLS = b"#*$%&|<>"
_LONG = 64  # bytes; of longer lines and windows a digest is compared

_random = np.random.default_rng(SEED)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODDS = _random.integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


@dataclass
class Parsed:
    """Several texts in one array, with their words, lines and hashes."""

    data: np.ndarray
    text_at: np.ndarray  # where each text begins, and the end
    word_from: np.ndarray
    word_to: np.ndarray
    word_text: np.ndarray  # the text of each word
    word_hash: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Parsed:
        # A line feed after each text ends its last word and line.
        data, ends = joined([t + b"\n" for t in texts])
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[1], space.astype(np.int8)]))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self = cls(data, ends, begin, end, np.searchsorted(ends, begin, "right") - 1, np.empty(0, np.uint64))
        self.word_hash = self.spans(begin, end)
        return self

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, from prefix sums."""

        if not hasattr(self, "_prefix"):
            powers = _powers(_BASE, len(self.data)) if len(self.data) else np.empty(0, np.uint64)
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * powers, dtype=np.uint64)])
            self._back = _powers(_BACK, len(self.data) + 1)
        length = (end - begin).astype(np.uint64)
        return _mix((self._prefix[end] - self._prefix[begin]) * self._back[begin] + length)


def _again(keys: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once, in order."""

    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = held[1:] == held[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return np.flatnonzero(out)


def _short(key: bytes) -> bytes:
    return key if len(key) <= _LONG else blake2b(key, digest_size=16).digest()


def counts(texts: list[bytes], parsed: Parsed | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""

    p = parsed or Parsed.of(texts)
    n, at = len(texts), p.text_at
    words = np.bincount(p.word_text, minlength=n)
    chars = ((p.data & 0xC0) != 0x80) & ~_SPACE[p.data]
    symbols = _SYMBOL[p.data]

    feeds = np.flatnonzero(p.data == 10)
    line_from = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else feeds
    has_word = _sums(~_SPACE[p.data], line_from, feeds) > 0
    line_from, feeds = line_from[has_word], feeds[has_word]
    line_text = np.searchsorted(at, line_from, "right") - 1
    salt = _mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE)
    # Hashes only choose what is compared: equal ones can belong to different lines.
    raw = p.data.tobytes()
    seen, doubled = set(), []
    for i in _again(p.spans(line_from, feeds) ^ salt[line_text]).tolist():
        line = int(line_text[i]), _short(raw[line_from[i] : feeds[i]])
        if line in seen:
            doubled.append(i)
        seen.add(line)

    repeated = np.zeros(n, np.int64)
    m = len(p.word_hash) - WINDOW + 1
    if m > 0:
        key = salt[p.word_text[:m]].copy()
        for k in range(WINDOW):
            key += p.word_hash[k : k + m] * _ODDS[k]
        inside = np.flatnonzero(p.word_text[:m] == p.word_text[WINDOW - 1 :])
        maybe = inside[_again(_mix(key[inside]))]
        ends = p.word_to[maybe + WINDOW - 1].tolist()
        # bytes.split knows the same white space as the contract.
        held = [_short(b" ".join(raw[b:e].split())) for b, e in zip(p.word_from[maybe].tolist(), ends)]
        held = list(zip(p.word_text[maybe].tolist(), held))
        times = Counter(held)
        twice = maybe[np.array([times[x] > 1 for x in held], bool)]
        covered = np.zeros(len(p.word_hash) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
        repeated = np.bincount(p.word_text[np.cumsum(covered[:-1]) > 0], minlength=n)
    return {
        "n_words": words,
        "word_chars": _sums(chars, at[:-1], at[1:]),
        "n_symbols": _sums(symbols, at[:-1], at[1:]),
        "n_dup_lines": np.bincount(line_text[np.array(doubled, np.int64)], minlength=n),
        "n_repeat_words": repeated,
    }


def features(p: Parsed) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for character n-grams: buckets, and the text of each."""

    words = (p.word_hash % np.uint64(BUCKETS)).astype(np.int64)
    m = len(p.data) - GRAM + 1
    if m <= 0:
        return [(words, p.word_text), (np.empty(0, np.int64), np.empty(0, np.int64))]
    key = np.zeros(m, np.uint64)
    for k in range(GRAM):
        key += _BYTE[p.data[k : k + m]] * _ODDS[k]
    text = np.repeat(np.arange(len(p.text_at) - 1), np.diff(p.text_at))
    inside = text[:m] == text[GRAM - 1 :]
    grams = (_mix(key[inside]) >> np.uint64(40)) % np.uint64(BUCKETS)
    return [(words, p.word_text), (grams.astype(np.int64) + BUCKETS, text[:m][inside])]


@dataclass
class Model:
    weights: np.ndarray  # of words' buckets, then of n-grams'
    slope: float
    intercept: float

    def margin(self, p: Parsed) -> np.ndarray:
        n = len(p.text_at) - 1
        out = np.zeros(n)
        for index, text in features(p):
            held = np.bincount(text, minlength=n)
            out += np.bincount(text, self.weights[index], minlength=n) / np.maximum(held, 1)
        return out

    def probability(self, p: Parsed) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(p) + self.intercept, -30, 30)))


def _calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a (weighted) logistic fit of the labels to the margins.

    Newton steps on the standardised margins, halved until the loss falls; goals
    a little inside 0 and 1 keep the fit finite where labels are separated.
    """

    up, down = (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2)
    goal = np.where(label == 1, up, down)
    weight = np.ones(len(label)) if weight is None else weight
    middle, spread = margin.mean(), margin.std() or 1.0
    x = np.stack([(margin - middle) / spread, np.ones(len(margin))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - goal * z)).sum() + 1e-3 * w[0] ** 2)

    w = np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - goal)) + np.array([2e-3 * w[0], 0])
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([2e-3, 1e-6])
        step, now = np.linalg.solve(h, g), loss(w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _weighed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts, the text of each, and its share there; one text's arrays at a time."""

    index, owner, value = [], [], []
    for i, text in enumerate(texts):
        for found, _ in features(Parsed.of([text])):
            bucket, count = np.unique(found, return_counts=True)
            index.append(bucket.astype(np.int32))
            owner.append(np.full(len(bucket), i, np.int32))
            value.append((count / max(count.sum(), 1)).astype(np.float32))
    return np.concatenate(index), np.concatenate(owner), np.concatenate(value)


def fit(
    texts: list[bytes], labels: list[int], rounds: int = 60, rate: float = 2.0, decay: float = 1e-4, share: float | None = None
) -> Model:
    """Adagrad on the mean log loss; every fourth row only calibrates.

    ``share`` is how many of all texts are good, if the given ones were chosen
    by label.
    """

    order = np.random.default_rng(SEED).permutation(len(texts))
    y = np.array(labels, float)[order]
    texts = [texts[i] for i in order]
    held = np.arange(len(texts)) % 4 == 0
    if len(texts) < 8 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        # Too little to learn from: the smoothed share of good rows for every text.
        share = (sum(y) + 1) / (len(y) + 2) if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(2 * BUCKETS), 1.0, float(np.log(share / (1 - share))))
    goal = y[~held]
    n = len(goal)
    index, text, value = _weighed([t for t, h in zip(texts, held) if not h])
    w, seen, bias = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-8), 0.0
    weight = np.where(goal == 1, 0.5 / max(goal.sum(), 1), 0.5 / max((1 - goal).sum(), 1)) * n
    for _ in range(rounds):
        z = np.bincount(text, w[index] * value, minlength=n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) * weight / n
        step = np.bincount(index, g[text] * value, minlength=2 * BUCKETS) + decay * w / n
        seen += step * step
        w -= rate * step / np.sqrt(seen)
        bias -= g.sum()
    model = Model(w, 1.0, 0.0)
    margin = np.array([model.margin(Parsed.of([t]))[0] for t, h in zip(texts, held) if h])
    given = y.mean()
    share = given if share is None else min(max(share, 1e-6), 1 - 1e-6)
    balance = np.where(y[held] == 1, share / given, (1 - share) / (1 - given))
    model.slope, model.intercept = _calibrate(margin, y[held], balance)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, seed: int, where=None) -> list:
    """At most ``rows`` labelled texts of each label, in a seeded order of ids."""

    known = labels.where(F.col(column).isin(0, 1)).select("doc_id", F.col(column).alias("y"))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("t"))
    found = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "t", "y").collect()
    return sorted(found, key=lambda r: (r.doc_id, bytes(r.t)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    found = labelled_sample(docs, labels, "quality", rows, SEED)
    # The sample bounds each label by itself; how many are good is counted over all labelled documents.
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = known.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("y")).first()[0]
    return fit([bytes(r.t) for r in found], [r.y for r in found], share=share)


def judge(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, probability, base_failed, kept) for each row's whole text.

    A text fails the base rules with fewer than ``MIN_WORDS`` words or too many
    words in repeated windows; else it is kept if its probability of good
    quality is at least ``threshold``. A null text has no words. A long text is
    read whole, alone in its chunk. Repeated rows come back each; null ids stay
    null; other columns, whatever their names, play no part. An empty table
    gives an empty result.
    """

    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for rows, texts in chunks(batch, "t", CHUNK):
                p = Parsed.of(texts)
                found = counts(texts, p)
                failed = (found["n_words"] < MIN_WORDS) | (MAX_REPEATED[1] * found["n_repeat_words"] > MAX_REPEATED[0] * found["n_words"])
                good = known.probability(p)
                columns = [pa.array(found[c].astype(np.int64)) for c in names]
                kept = ~failed & (good >= threshold)
                yield pa.record_batch(
                    [batch.column(0)[rows], *columns, pa.array(good), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *names, "probability", "base_failed", "kept"],
                )

    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    kinds = ", ".join(f"{c} long" for c in names)
    return given.mapInArrow(run, f"doc_id long, {kinds}, probability double, base_failed boolean, kept boolean")
