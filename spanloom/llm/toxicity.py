"""Toxicity by a string-kernel support vector machine.

The kernel counts common subsequences of three letters, each weighted by a
decay to the power of the stretch it spans, so inserted characters and gaps
lower the value without losing the match. Words are compared with landmark
words, in whose span the machine is fitted (Nyström). A sentence scores as its
highest word, a text as its highest sentence. Landmarks and the machine are
learnt from the sentences of a bounded sample of labelled texts, each word with
the label of its sentence's text. Margins are calibrated to probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import chunks
from spanloom.llm.quality import _calibrate, labelled_sample

TRAIN_ROWS = 1_500  # labelled rows to learn from, at most so many of each label
SEED = 29
LANDMARKS = 24
MIN_SHARE = 0.01  # of the toxic texts a landmark must occur in
DECAY = 0.8
REACH = 8  # the longest stretch of a subsequence
PART = 32  # longer words are compared in overlapping parts
FLOOR = 0.25  # smaller kernel values count as 0
PENALTY = 1e-4
WORDS_AT_ONCE = 5_000  # of which the kernel's tables are held
MEMORY = 200_000  # words a Python worker remembers

_LETTERS = 32  # a to z, then other characters
_SENTENCE = re.compile("[.!?\n]+(?:\\s|$)")
# Single letters with blanks or marks between them, as in "x y z" or "x.y.z".
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[^\w\n]{1,3}[^\W_](?![^\W_])){2,}")
_JOIN = re.compile(r"[\W_]+")
_LIKE = str.maketrans("013457@$", "oieastas")  # digits and marks written for letters
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))

_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _codes(word: str) -> np.ndarray:
    return np.array([ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 6 for c in word], np.int64)


def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all three-letter subsequences of n letters within reach, and weights."""

    if n not in _triples:
        found = [t for i in range(n) for t in combinations(range(i, min(n, i + REACH)), 3) if t[0] == i]
        at = np.array(found, np.int64).reshape(-1, 3)
        _triples[n] = at, DECAY ** (at[:, 2] - at[:, 0] + 1).astype(float)
    return _triples[n]


def _spectrum(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (rows): subsequence codes and weights over the word's norm."""

    at, weight = _subsequences(codes.shape[1])
    triple = (codes[:, at[:, 0]] * _LETTERS + codes[:, at[:, 1]]) * _LETTERS + codes[:, at[:, 2]]
    order = np.argsort(triple, axis=1, kind="stable")
    triple, weights = np.take_along_axis(triple, order, 1), weight[order]
    # Equal subsequences of a word add up on the last of them.
    total = np.cumsum(weights, axis=1)
    last = np.ones(triple.shape, bool)
    last[:, :-1] = triple[:, 1:] != triple[:, :-1]
    rows, places = np.nonzero(last)
    upto = total[rows, places]
    before = np.concatenate([[0.0], upto[:-1]])
    before[np.concatenate([[True], rows[1:] != rows[:-1]])] = 0.0
    summed = np.zeros(triple.shape)
    summed[rows, places] = upto - before
    norm = np.sqrt((summed**2).sum(axis=1, keepdims=True))
    return triple, summed / np.maximum(norm, 1e-12)


def _parts(word: str) -> list[str]:
    if len(word) <= PART:
        return [word]
    return [word[i : i + PART] for i in range(0, len(word) - PART // 2, PART // 2)]


class Kernel:
    """Values of words with fixed landmarks, each at least ``FLOOR`` or 0."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.table = np.zeros((_LETTERS**3, len(landmarks)), np.float32)
        for j, word in enumerate(landmarks):
            triple, value = _spectrum(_codes(word)[None, :])
            np.add.at(self.table, (triple[0], j), value[0])

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for part in _parts(word):
                if len(part) >= 3:
                    by_length.setdefault(len(part), []).append((i, part))
        for length, found in by_length.items():
            for at in range(0, len(found), 1000):
                some = found[at : at + 1000]
                triple, value = _spectrum(np.array([_codes(w) for _, w in some]))
                hit = self.known[triple] & (value > 0)
                rows, places = np.nonzero(hit)
                k = np.zeros((len(some), len(self.landmarks)), np.float32)
                if len(rows):
                    each = self.table[triple[rows, places]] * value[rows, places][:, None].astype(np.float32)
                    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    k[rows[first]] = np.add.reduceat(each, first, axis=0)
                np.maximum.at(out, [i for i, _ in some], k)
        out[out < FLOOR] = 0
        return out

    @property
    def known(self) -> np.ndarray:
        if not hasattr(self, "_known"):
            self._known = self.table.any(axis=1)
        return self._known


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; also without inner marks, and spelled-out ones joined."""

    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = [w.strip(_EDGE) for w in sentence.split()]
        words += [_JOIN.sub("", w.translate(_LIKE)) for w in words if not w.isalpha()]
        words += [_JOIN.sub("", m) for m in _SPACED.findall(sentence)] if _SPACED.search(sentence) else []
        out.append(words)
    return out


class Model:
    """Landmarks with weights; scores texts and remembers words."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, intercept: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slope, self.intercept = slope, intercept

    def __getstate__(self):
        return self.landmarks, self.weights, self.bias, self.slope, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    def margins(self, texts: list[str]) -> np.ndarray:
        if not hasattr(self, "kernel"):
            self.kernel, self.memory = Kernel(self.landmarks), {}
        split = [[w for words in sentences(t) for w in words] for t in texts]
        words = set().union(*split)
        new = [w for w in words if w not in self.memory]
        # Full: the words met first are the frequent ones and stay; others serve this call only.
        here = self.memory if len(self.memory) + len(new) <= MEMORY else {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            here.update(zip(some, (self.kernel.values(some) @ self.weights + self.bias).tolist()))
        own = {w: self.memory[w] if w in self.memory else here[w] for w in words}
        return np.array([max(map(own.__getitem__, words), default=self.bias) for words in split])

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -30, 30)))


def _landmarks(texts: list[list[list[str]]], labels: np.ndarray, share: float) -> list[str]:
    """Words that set toxic texts apart, highest z score of their sentence frequencies first.

    Each distinct sentence counts once, so near copies of a text do not make
    its words landmarks; and most texts with the word must be toxic when a
    ``share`` of all texts is.
    """

    held: list[set] = [set(), set()]
    seen = [Counter(), Counter()]
    for text, y in zip(texts, labels):
        held[int(y)].update(tuple(s) for s in text if s)
        seen[int(y)].update({w for s in text for w in s})
    hits = [Counter(w for s in side for w in set(s)) for side in held]
    n0, n1 = (max(len(side), 1) for side in held)
    t1, t0 = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    score = {}
    for word, k in hits[1].items():
        likely, other = share * seen[1][word] / t1, (1 - share) * seen[0][word] / t0
        if 3 <= len(word) <= PART and k >= max(3, MIN_SHARE * t1) and likely > other:
            p1, p0 = k / n1, hits[0][word] / n0
            p = (k + hits[0][word] + 1) / (n1 + n0 + 2)
            score[word] = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return [w for w, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:LANDMARKS] if s > 3]


def _svm(k: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Squared hinge loss with the norm in the landmarks' span as penalty.

    ``k`` has kernel values with the landmarks, ``own`` the landmarks' own. In
    Nyström's coordinates (the inverse root of ``own``) this is a linear
    machine; here it is solved for the landmarks' coefficients, which are kept
    at 0 or more: likeness to an insult never speaks for a text. Accelerated
    projected gradient steps.
    """

    x = np.hstack([k, np.ones((len(k), 1))])
    norm = np.zeros((x.shape[1], x.shape[1]))
    norm[:-1, :-1] = own
    step = 1 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + 2 * PENALTY * np.linalg.norm(norm, 2))
    w = ahead = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (-2 * x.T @ (weight * y * slack) + 2 * PENALTY * norm @ ahead)
        new[:-1] = np.maximum(new[:-1], 0)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """A model from labelled texts; without both labels every text scores their share.

    ``share`` is how many of all texts are toxic, if the given ones were chosen
    by label.
    """

    pairs = sorted(set(zip(texts, labels)))  # copies would count twice
    texts, y = [t for t, _ in pairs], np.array([v for _, v in pairs], int)
    share = float((y.sum() + 1) / (len(y) + 2)) if share is None else min(max(share, 1e-6), 1 - 1e-6)
    plain = Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    split = [sentences(t) for t in texts]
    landmarks = _landmarks(split, y, share) if len(set(y.tolist())) == 2 else []
    if not landmarks:
        return plain
    kernel = Kernel(landmarks)
    own = kernel.values(landmarks).astype(float)
    own = (own + own.T) / 2
    # Every word of a sentence carries its text's label; equal words weigh together.
    prior = (1 - share) / max((1 - y).sum(), 1), share / max(y.sum(), 1)
    mass: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(split, y):
        for word in {w for s in text for w in s}:
            mass[label][word] += prior[label]
    words = list(mass[0].keys() | mass[1].keys())
    values = kernel.values(words).astype(float)
    active = values.any(axis=1)
    heard = [w for w, a in zip(words, active) if a]
    k = np.vstack([values[active], values[active], np.zeros((2, len(landmarks)))])
    weight = np.array([mass[1][w] for w in heard] + [mass[0][w] for w in heard] + [share, 1 - share])
    sign = np.repeat([1.0, -1.0, 1.0, -1.0], [len(heard), len(heard), 1, 1])
    w, bias = _svm(k[weight > 0], own, sign[weight > 0], weight[weight > 0] / weight.sum())
    model = Model(landmarks, w, bias, 1.0, 0.0)
    margins = model.margins(texts)
    balance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.slope, model.intercept = _calibrate(margins, y, balance)
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where=None) -> Model:
    """A model from at most ``rows`` labelled documents of each label among ``where``."""

    found = labelled_sample(docs, labels, "toxic", rows, SEED, where)
    known = labels if where is None else labels.where(where)
    share = known.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    return fit([bytes(r.t).decode() for r in found], [r.y for r in found], share)


def learning_rows(id_column: str = "doc_id"):
    """Rows to learn from: a fifth, by a checksum of the id, is held out."""

    return F.crc32(F.encode(F.col(id_column).cast("string"), "utf-8")) % 5 != 0


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score): the probability that each row's whole text is toxic.

    Null and empty texts score as a text without insults. Repeated rows come
    back each; null ids stay null; other columns play no part.
    """

    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for rows, texts in chunks(batch, "t"):
                values = known.probability(known.margins([t.decode() for t in texts]))
                yield pa.record_batch([batch.column(0)[rows], pa.array(values)], names=["doc_id", "score"])

    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return given.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for rows, texts in chunks(named, str(column)):
                values = known.probability(known.margins([t.decode() for t in texts]))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield part.filter(pa.array(values < threshold))

    return docs.mapInArrow(run, docs.schema)
