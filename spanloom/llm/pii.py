"""Personal data: fixed forms, and a character-level BiLSTM with a CRF on top.

The network is trained in numpy on the fixed forms' spans in a bounded sample of
documents, and on the same spans written in other ways ("name at host dot org",
other separators), which is what it adds to the fixed forms. Windows that
overlap are tagged one by one and reconciled over the whole text: each character
takes its tag from the window in which it lies deepest, and spans are read from
the tags of the whole text. A span counts if, read back to the plain form, it is
one of the kind.

The windows lie on a fixed grid over the whole text. Those that cannot touch a
span that counts are not run: every such span, of any length, lies in one of
``_possible``'s stretches, so the spans found are those of all windows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import chunks, seeded

# Documents with a span of each kind, with only other digits or @, and others, that the network learns from, at most.
TRAIN_ROWS = 400
SEED = 37
HIDDEN = 12
WINDOW = 128
OVERLAP = 48
STEPS = 220
BATCH = 48
RATE = 0.03
WINDOWS_AT_ONCE = 4096

# The contract's kinds in order, and their forms.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
# Of the spans that _valid accepts: all characters of an address, and what each
# address has; all characters from a card's or phone's first digit on; what no ip holds.
_ADDRESS = re.compile(r"[A-Za-z0-9._%+@\s\[\](){}<>-]+")
_AT = re.compile(r"@|\bat\b", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9][0-9\s().+/_-]*")
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile("[A-Za-z]{4,}")
_STRIPPED = " \n\t,;:"  # at both ends of a tagged stretch; on the right also a full stop

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_CLASSES = 130


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        match = _DOMAIN.match(text, at) if first < at else None
        if match:
            yield first, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _is_byte(digits: str) -> bool:
    """At most 255, however many zeros lead and however long the run is."""

    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind, then start; code points."""

    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_is_byte(x) for x in m.group().split("."))] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _valid(kind: int, text: str) -> bool:
    """Whether a tagged stretch reads back to its kind's plain form."""

    if kind == 0:
        plain = re.sub(r"\s*[\[({<]?\s*\b(?:at)\b\s*[\])}>]?\s*", "@", text, flags=re.IGNORECASE)
        plain = re.sub(r"\s*[\[({<]?\s*\b(?:dot)\b\s*[\])}>]?\s*", ".", plain, flags=re.IGNORECASE)
        plain = re.sub(r"\s*([@.])\s*", r"\1", plain)
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z]{4}", text)
    digits = _NOT_DIGIT.sub("", text)
    if re.search(r"[^0-9\s().+/_-]", text):
        return False
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and digits != text


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < 128, points, 128 + (points > 0x24F)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Parameters: for each direction gate inputs by character and by state; emissions; CRF."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (_CLASSES, 4 * h))
            self.p[f"x{d}"][:, h : 2 * h] += 1  # forget gates start open
            self.p[f"h{d}"] = rng.normal(0, 0.3, (h, 4 * h))
        self.p["out"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["bias"][0] = 1.0
        self.p["trans"] = rng.normal(0, 0.1, (TAGS, TAGS))

    def _lstm(self, codes: np.ndarray, d: str, keep: bool):
        """codes: time by batch. Hidden states, and what the backward pass needs."""

        h = HIDDEN
        x, w = self.p[f"x{d}"], self.p[f"h{d}"]
        steps, batch = codes.shape
        state, cell = np.zeros((batch, h), x.dtype), np.zeros((batch, h), x.dtype)
        out, tape = np.empty((steps, batch, h), x.dtype), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = x[codes[t]] + state @ w
            gates = _sigmoid(z[:, : 3 * h])  # in, forget, out
            new = np.tanh(z[:, 3 * h :])
            before, cell_before = state, cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[t] = state
            if keep:
                tape.append((t, gates, new, before, cell_before, squashed))
        return out, tape

    def emissions(self, codes: np.ndarray, keep: bool = False):
        f, tape_f = self._lstm(codes, "f", keep)
        b, tape_b = self._lstm(codes, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, (tape_f, tape_b)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags (time by batch), and its gradient."""

        e, both, tapes = self.emissions(codes, keep=True)
        trans = self.p["trans"]
        steps, batch, k = e.shape
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, steps):
            ahead[t] = e[t] + _logsumexp(ahead[t - 1][:, :, None] + trans[None], 1)
        for t in range(steps - 2, -1, -1):
            back[t] = _logsumexp(trans[None] + (e[t + 1] + back[t + 1])[:, None, :], 2)
        whole = _logsumexp(ahead[-1], 1)
        single = np.exp(ahead + back - whole[None, :, None])
        pair = np.zeros((k, k))
        for t in range(1, steps):
            joint = ahead[t - 1][:, :, None] + trans[None] + (e[t] + back[t])[:, None, :] - whole[:, None, None]
            pair += np.exp(joint).sum(axis=0)
        gold = np.zeros_like(single)
        np.put_along_axis(gold, tags[:, :, None], 1.0, 2)
        score = (e * gold).sum(axis=(0, 2)) + trans[tags[:-1], tags[1:]].sum(axis=0)
        counted = np.zeros((k, k))
        np.add.at(counted, (tags[:-1].ravel(), tags[1:].ravel()), 1.0)
        de = (single - gold) / batch
        g = {
            "trans": (pair - counted) / batch,
            "bias": de.sum(axis=(0, 1)),
            "out": np.einsum("tbh,tbk->hk", both, de),
        }
        dboth = de @ self.p["out"].T
        h = HIDDEN
        for d, tape, dh_all in (("f", tapes[0], dboth[:, :, :h]), ("b", tapes[1], dboth[:, :, h:])):
            w = self.p[f"h{d}"]
            gx, gw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(w)
            dstate, dcell = np.zeros((batch, h)), np.zeros((batch, h))
            for t, gates, new, before, cell_before, squashed in reversed(tape):
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dh = dh_all[t] + dstate
                dc = dcell + dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    [dc * new * i * (1 - i), dc * cell_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1
                )
                np.add.at(gx, codes[t], dz)
                gw += before.T @ dz
                dstate, dcell = dz @ w.T, dc * f
            g[f"x{d}"], g[f"h{d}"] = gx, gw
        return float((whole - score).mean()), g

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (time by batch) under the CRF."""

        e, _, _ = self.emissions(codes)
        trans = self.p["trans"]
        steps = len(e)
        best, via = e[0], np.empty(e.shape, np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + trans[None]
            via[t] = paths.argmax(axis=1)
            best = np.take_along_axis(paths, via[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        tags = np.empty(e.shape[:2], np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(via[t], tags[t][:, None], 1)[:, 0]
        return tags

    def light(self) -> Tagger:
        """The same in single precision."""

        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self


def _rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """The span as people also write it."""

    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), (" AT ", " DOT "))
        name, host = text.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == 1:
        return text.replace(".", pick("[.]", " . ", "(.)", " dot "))
    digits = _NOT_DIGIT.sub("", text)
    if kind == 2:
        return pick(".", "/", "  ", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10]} {a} {b} {c}")


def _windows(texts: list[str], rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Training windows (count by WINDOW): characters and tags."""

    spans = [(i, s) for i, t in enumerate(texts) for s in base_spans(t)]
    by_kind = [[x for x in spans if x[1][0] == k] for k in range(len(KINDS))]
    codes, tags = np.full((count, WINDOW), 32, np.int64), np.zeros((count, WINDOW), np.int64)
    for n in range(count):
        text = texts[rng.integers(len(texts))]
        filler = lambda k: text[(a := int(rng.integers(max(1, len(text) - k)))) : a + k]  # noqa: B023, E731
        kind = int(rng.integers(len(KINDS)))
        draw = rng.random()
        if draw < 0.7 and by_kind[kind]:
            i, (_, a, b) = by_kind[kind][rng.integers(len(by_kind[kind]))]
            piece = texts[i][a:b]
            if rng.random() < 0.7:
                piece = _rewritten(kind, piece, rng)
            piece, marked = piece[: WINDOW - 20], True
        elif draw < 0.85:
            # Numbers of other kinds: dates, versions, amounts, long counters.
            d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
            forms = (f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)}", f"{d(int(rng.integers(1, 8)))}", f"{d(2)}:{d(2)}", f"{d(20)}", f"#{d(5)}")
            piece, marked = forms[rng.integers(len(forms))], False
        else:
            piece, marked = "", False
        before = int(rng.integers(4, WINDOW - len(piece) - 3))
        line = filler(before).ljust(before)[: before - 1] + " " + piece
        line = (line + " " + filler(WINDOW)).ljust(WINDOW)[:WINDOW]
        codes[n] = classes(line)
        for k, a, b in base_spans(line):
            tags[n, a] = 1 + 2 * k
            tags[n, a + 1 : b] = 2 + 2 * k
        if marked:
            tags[n, before : before + len(piece)] = 2 + 2 * kind
            tags[n, before] = 1 + 2 * kind
    return codes, tags


def fit(texts: list[str], steps: int = STEPS) -> Tagger | None:
    """A tagger from the spans of ``texts``; None if they have no spans."""

    texts = sorted({t for t in texts if t})
    if not any(base_spans(t) for t in texts):
        return None
    rng = np.random.default_rng(SEED)
    model = Tagger(rng)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        codes, tags = _windows(texts, rng, BATCH)
        _, g = model.gradients(codes.T, tags.T)
        norm = np.sqrt(sum((v**2).sum() for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():  # Adam
            v = v * min(1.0, 5 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            model.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return model.light()


def _of_each_kind(keyed: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the (id, t) with each kind of base span, and of those with a digit or @ but no span.

    All rows are looked at, so a kind that any of them holds has its examples
    however rare it is. Only hashes are ranked, the first of each task before
    they are shuffled.
    """

    hashed = keyed.where(F.col("t").rlike("[0-9@]")).withColumn("o", F.xxhash64(F.lit(SEED), "id", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                hashes, found = batch.column(0)[part].to_pylist(), []
                for o, text in zip(hashes, texts):
                    found += [(o, k) for k in {k for k, _, _ in base_spans(text.decode())} or {len(KINDS)}]
                yield pa.record_batch([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["o", "kind"])

    kinds = hashed.select("o", "t").mapInArrow(run, "o long, kind long")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("o"))
    # Rows that tie are alike, so equal hashes of a kind are one example.
    chosen = kinds.distinct().withColumn("n", place).where(F.col("n") <= rows).select("o").distinct()
    return hashed.join(F.broadcast(chosen), "o").dropDuplicates(["o"]).select("id", "t")


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> Tagger | None:
    """A tagger from at most ``rows`` documents of each kind of span, as many with
    a digit or @ but no span, and as many others.

    Warns of kinds that no document holds: the network does not learn these.
    """

    keyed = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    others = seeded(keyed.where(~F.col("t").rlike("[0-9@]")), rows, SEED)
    texts = [r.t for r in _of_each_kind(keyed, rows).unionByName(others).select("t").collect()]
    held = {k for t in texts for k, _, _ in base_spans(t)}
    missing = [name for k, name in enumerate(KINDS) if k not in held]
    if missing:
        warnings.warn(f"No document holds {', '.join(missing)} in a fixed form: the tagger learns no example of it", stacklevel=2)
    return fit(texts)


def _possible(text: str) -> list[tuple[int, int]]:
    """Stretches, by start, one of which holds all of any span that ``_valid`` accepts."""

    out = []
    if _AT.search(text):
        out += [m.span() for m in _ADDRESS.finditer(text) if _AT.search(text, *m.span())]
    if _DIGIT.search(text) is None:
        return out
    for m in _NUMBER.finditer(text):
        if len(_NOT_DIGIT.sub("", m.group())) >= 8:
            a = m.start()
            while a and (text[a - 1] in "().+/_-" or text[a - 1].isspace()):
                a -= 1
            out.append((a, m.end()))
    # Four numbers or more without a word of four letters between them.
    runs = [m.span() for m in _DIGITS.finditer(text)]
    first = 0
    for i in range(1, len(runs) + 1):
        if i == len(runs) or _WORD.search(text, runs[i - 1][1], runs[i][0]):
            if i - first >= 4:
                after = _WORD.search(text, runs[i - 1][1])
                out.append((_word_before(text, runs[first][0]), after.start() + 3 if after else len(text)))
            first = i
    return sorted(out)


def _word_before(text: str, at: int) -> int:
    """Where the last three letters of the last word of four begin before ``at``; else 0."""

    size = 64
    while True:
        words = [m.end() for m in _WORD.finditer(text, max(0, at - size), at)]
        if words or size >= at:
            return words[-1] - 3 if words else 0
        size *= 4


def _layout(text: str) -> list[tuple[int, int]]:
    """The windows (start, end) of the grid that touch a possible span.

    Also the character before and after it, stripped ones apart, is looked at: a
    tagged stretch that goes on there does not count.
    """

    stride, last = WINDOW - OVERLAP, max(0, -((WINDOW - len(text)) // (WINDOW - OVERLAP)))
    out, done = [], -1
    for a, b in _possible(text):
        while a and text[a - 1] in _STRIPPED:
            a -= 1
        while b < len(text) and text[b] in _STRIPPED + ".":
            b += 1
        a, b = max(0, a - 1), min(len(text), b + 1)
        for n in range(max(done + 1, -((WINDOW - 1 - a) // stride), 0), min(last, (b - 1) // stride) + 1):
            out.append((n * stride, min(n * stride + WINDOW, len(text))))
            done = n
    return out


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the network finds in each text, before base spans come in."""

    windows = [(i, a, b) for i, text in enumerate(texts) for a, b in _layout(text)]
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at in range(0, len(windows), WINDOWS_AT_ONCE):
        some = windows[at : at + WINDOWS_AT_ONCE]
        codes = np.full((len(some), WINDOW), 32, np.int64)
        for row, (i, a, b) in enumerate(some):
            codes[row, : b - a] = classes(texts[i][a:b])
        best = model.decode(codes.T).T
        for row, (i, a, b) in enumerate(some):
            if i not in tags:
                tags[i] = np.zeros(len(texts[i]), np.int8), np.full(len(texts[i]), -1, np.int32)
            tag, depth = tags[i]
            place = np.arange(b - a)
            here = np.minimum(place if a else place + WINDOW, (b - a - 1 - place) if b < len(texts[i]) else WINDOW + place[::-1])
            deeper = here > depth[a:b]
            tag[a:b][deeper] = best[row, : b - a][deeper]
            depth[a:b][deeper] = here[deeper]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (tag, _) in tags.items():
        kind = (tag.astype(np.int64) + 1) // 2
        edges = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tag % 2 == 1) & (kind > 0)))
        for a, b in zip(edges, [*edges[1:], len(tag)]):
            if kind[a]:
                out[i].append((int(kind[a]) - 1, int(a), int(b)))
    return out


def spans_of(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans: those and the network's that touch none of them."""

    base = [base_spans(t) for t in texts]
    found = tagged_spans(texts, model) if model else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, found):
        held = sorted((a, b) for _, a, b in own)
        added = []
        for kind, a, b in more:
            inner = text[a:b]
            a, b = a + len(inner) - len(inner.lstrip(_STRIPPED)), b - len(inner) + len(inner.rstrip(_STRIPPED + "."))
            if a < b and _valid(kind, text[a:b]) and not any(x < b and a < y for x, y in held):
                added.append((kind, a, b))
        out.append((own, sorted(own + added)))
    return out


def find(docs: DataFrame, model: Tagger | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, spans) for each row: arrays of (kind, s, e) by kind, then start.

    A null text counts as empty and has none. Repeated rows come back each; null
    ids stay null; other columns play no part. Without a model only base spans
    are found.
    """

    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    def shaped(spans: list) -> list[dict]:
        return [{"kind": KINDS[k], "s": a, "e": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "t"):
                found = spans_of([t.decode() for t in texts], sent.value)
                columns = [pa.array([shaped(x[j]) for x in found], kind) for j in (0, 1)]
                yield pa.record_batch([batch.column(0)[rows], *columns], names=["doc_id", "base", "spans"])

    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    each = "array<struct<kind:string,s:long,e:long>>"
    return given.mapInArrow(run, f"doc_id long, base {each}, spans {each}")
