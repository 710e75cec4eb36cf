"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers cut the same bytes, so a token is given by where it ends. The
two end arrays are compared at the current index shift (the diagonal): probes of
doubling length jump over stretches where token ends token. Where they part, the
group is closed locally, by moving on the side that lies behind until both end
together, which gives the shift for the next stretch.

A text's linked id pairs are stored once a text with their number of links. How
many texts hold a pair is a native count with map-side sums. The frequent pairs'
counts go to all tasks, at most ``head_pairs`` of them; the texts' other pairs
are joined in a shuffle, where no pair is hot, since the hot ones are gone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import byte_symbols, chunks
from spanloom.session import Workspace

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
HEAD_PAIRS = 1_000_000  # counts that every task gets: 16 bytes each
LONG_WORD = 1_000  # code points; beyond, only the exact tokenizer's merging stays fast
CHUNK_BYTES = 6 << 20  # text whose distinct words are encoded once
WORDS_AT_ONCE = 256  # distinct words in one call of the tokenizers
LARGE_GROUP = 4_096  # links of a group that are listed one by one

# Characters whose class (letter, number, space) no Unicode version has changed.
_USUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧]")

# A blank beside other white space; where there is none, both sides begin a token at each blank.
_WIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")

_STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<long>"


def _place(name: str) -> str:
    """``name`` is looked up on the machine that runs the task, unless it is a path."""

    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Token ids of both tokenizers, and the bytes of each id."""

    def __init__(self, a_file: str, a_ranks: str | None, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(_place(a_file))
        self.exact.encode_special_tokens = True  # their strings in a text are plain text
        symbols = byte_symbols()
        self.bytes_a: list[bytes] = []
        for i in range(self.exact.get_vocab_size()):
            entry = self.exact.id_to_token(i) or ""
            known = all(c in symbols for c in entry)
            self.bytes_a.append(bytes(symbols[c] for c in entry) if known else entry.encode())
        self.fast = self._same_vocabulary(a_ranks) if a_ranks else None

        self.b = sentencepiece.SentencePieceProcessor(model_file=_place(b_file))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b):
            self.fast = None  # a blank behind another character: words can't be taken apart
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # The forms of an id in a group's text: inside its side, and last of its side.
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        a, b = range(self.size_a), range(self.size_b)
        self.forms = [*(f"{i}," for i in a), *(f"{i}|" for i in a), *(f"{i}," for i in b), *(f"{i};" for i in b)]

    def _same_vocabulary(self, ranks: str):
        """The same merges in a faster library, for texts that both split alike."""

        import public_tokenizers
        import tiktoken

        with open(_place(ranks), "rb") as lines:
            merges = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}
        if any(self.bytes_a[rank] != entry for entry, rank in merges.items()):
            raise ValueError(f"{ranks} holds other entries than the first tokenizer")
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _whole(self, text: str, usual: bool) -> tuple[np.ndarray, np.ndarray] | None:
        b = self.b.encode(text, num_threads=1)
        if usual:
            first = self.fast.encode_to_numpy(" " + text, disallowed_special=())
            a = first.tolist()
        else:
            a = self.exact.encode(" " + text, add_special_tokens=False).ids
            first = np.array(a, np.int32)
        whole = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return first.astype("<i4"), np.array(b, "<i4")

    def _words(self, words: pa.Array) -> list[pa.ListArray] | None:
        """Ids of distinct words on either side, each as if behind a blank."""

        given = words.to_pylist()
        parts = [self._whole(" ".join(given[at : at + WORDS_AT_ONCE]), True) for at in range(0, len(given), WORDS_AT_ONCE)]
        if any(part is None for part in parts):
            return None
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        sides = []
        for ids, length in zip((np.concatenate(x) for x in zip(*parts)), (self.length_a, self.length_b)):
            cuts = np.searchsorted(np.cumsum(length[ids]), ends) + 1
            sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pa.array(ids)))
        return sides

    def ids(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id arrays of each text, or None where it has no tokens by the rule of ``align``.

        The first side cuts texts at blanks before it merges, and no entry of the
        second has a blank behind another character. So where blanks stand alone, a
        text's ids are those of its words, one after the other, and each distinct
        word of ``texts`` is encoded once.
        """

        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        decoded = [raw.decode() for raw in texts]
        plain = []
        if self.fast is not None:
            usual = (i for i, t in enumerate(decoded) if t and _USUAL.search(t) is None)
            plain = [i for i in usual if not any(x in f" {decoded[i]} " for x in _WIDE)]
        split = pc.split_pattern(pa.array([decoded[i] for i in plain], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        known = None
        if len(words) and pc.max(pc.utf8_length(words)).as_py() < LONG_WORD:
            known = self._words(words)
        if known is None:
            plain = []
        else:
            first = split.offsets.to_numpy()
            sides = []
            for side in known:
                taken = side.take(coded.indices)
                sides.append((taken.values.to_numpy().astype(np.int64), taken.offsets.to_numpy()[first]))
            for k, i in enumerate(plain):
                out[i] = tuple(ids[ends[k] : ends[k + 1]] for ids, ends in sides)
        for i in set(range(len(texts))).difference(plain):
            both = self._one(decoded[i]) if texts[i] else None
            out[i] = None if both is None else tuple(x.astype(np.int64) for x in both)
        return out

    def _one(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        usual = self.fast is not None and _USUAL.search(text) is None
        usual = usual and " " * LONG_WORD not in text and "\n" * LONG_WORD not in text
        return self._whole(text, usual and max(map(len, text.split()), default=0) < LONG_WORD)


@functools.cache
def coder(a_file: str, a_ranks: str | None, b_file: str) -> Coder:
    """One a Python worker."""

    return Coder(a_file, a_ranks, b_file)


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group, how many tokens of either side end with it or before.

    ``a`` and ``b`` are rising ends of the same bytes; their last ones are equal.
    """

    la, lb, n, m = a.tolist(), b.tolist(), len(a), len(b)
    ends_a: list[int] = []
    ends_b: list[int] = []
    i = j = 0
    while i < n:
        if la[i] == lb[j]:
            # A stretch of one to one: probe 1, 2, 4, ... ends further along the diagonal.
            width = 1
            first, shift, most = i, j - i, min(n - i, m - j)
            i += 1
            while i - first < most:
                width *= 2
                end = min(i + width, first + most)
                if width <= 8:
                    while i < end and la[i] == lb[i + shift]:
                        i += 1
                    if i < end:
                        break
                else:
                    same = a[i:end] == b[i + shift : end + shift]
                    gap = int(same.argmin())
                    if not same[gap]:
                        i += gap
                        break
                    i = end
            j = i + shift
            ends_a.extend(range(first + 1, i + 1))
            ends_b.extend(range(first + shift + 1, j + 1))
            continue
        # An irregular group: the side behind moves on until both end together.
        x, y = la[i], lb[j]
        while x != y:
            if x < y:
                i += 1
                x = la[i]
            else:
                j += 1
                y = lb[j]
        i += 1
        j += 1
        ends_a.append(i)
        ends_b.append(j)
    return np.array(ends_a, np.int64), np.array(ends_b, np.int64)


def links_of(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): the text's distinct linked id pairs, a * size_b + b, and their links."""

    in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    count = in_a * in_b
    listed = count <= LARGE_GROUP
    ka, kb, n = (ends_a - in_a)[listed], (ends_b - in_b)[listed], count[listed]
    width = np.repeat(in_b[listed], n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keys = a[np.repeat(ka, n) + nth // np.maximum(width, 1)] * size_b + b[np.repeat(kb, n) + nth % np.maximum(width, 1)]
    pairs, times = np.unique(keys, return_counts=True)
    if listed.all():
        return pairs, times
    parts, weights = [pairs], [times]
    for g in np.flatnonzero(~listed):
        own_a, n_a = np.unique(a[ends_a[g] - in_a[g] : ends_a[g]], return_counts=True)
        own_b, n_b = np.unique(b[ends_b[g] - in_b[g] : ends_b[g]], return_counts=True)
        parts.append((own_a[:, None] * size_b + own_b[None, :]).ravel())
        weights.append((n_a[:, None] * n_b[None, :]).ravel())
    pairs, place = np.unique(np.concatenate(parts), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, place, np.concatenate(weights))
    return pairs, times


def group_text(code: Coder, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides of each group."""

    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ends_a - 1] = last_b[ends_b - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.concatenate([[0], ends_b[:-1]])
    forms = np.empty(len(a) + len(b), np.int64)
    forms[np.arange(len(a)) + before_b[group_a]] = a + last_a * code.size_a
    forms[np.arange(len(b)) + ends_a[group_b]] = 2 * code.size_a + b + last_b * code.size_b
    return "".join(map(code.forms.__getitem__, forms.tolist()))[:-1]


def texts_links(docs: DataFrame, files: tuple[str, str | None, str], id_column: str, text_column: str, kind: str) -> DataFrame:
    """Per row, its tokens' and groups' numbers, the groups' digest, and its linked pairs."""

    pair_type = pa.list_(pa.int32() if kind == "int" else pa.int64())
    kinds = [pa.int64()] * 5 + [pa.string(), pair_type, pa.list_(pa.int64())]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(*files)
        for batch in batches:
            for rows, texts in chunks(batch, "t", CHUNK_BYTES):
                out: list[tuple] = []
                for ids in code.ids(texts):
                    if ids is None:
                        out.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
                        continue
                    a, b = ids
                    ends = shared_ends(np.cumsum(code.length_a[a]), np.cumsum(code.length_b[b]))
                    pairs, times = links_of(a, b, *ends, code.size_b)
                    digest = hashlib.sha256(group_text(code, a, b, *ends).encode()).hexdigest()
                    out.append((len(a), len(b), len(ends[0]), int(times.sum()), digest, pairs, times))
                columns = [batch.column(0)[rows], *(pa.array(c, k) for c, k in zip(zip(*out), kinds[1:]))]
                yield pa.record_batch(columns, names=names)

    given = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("t"))
    return given.mapInArrow(run, _STORED.format(kind=kind))


def _head(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs' counts reach."""

    power = F.floor(F.log2("n")).cast("int").alias("power")
    held = {r.power: r.pairs for r in counts.groupBy(power).agg(F.count("*").alias("pairs")).collect()}  # a row a power
    total = 0
    for power in sorted(held, reverse=True):
        total += held[power]
        if total > most:
            return 1 << (power + 1)
    return 1


def align(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    a_file: str = A_FILE,
    a_ranks: str | None = A_RANKS,
    b_file: str = B_FILE,
    head_pairs: int = HEAD_PAIRS,
    work: Workspace | None = None,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A text that is null or empty, or whose tokens of either side do not join to
    a blank and the text, has no tokens: zeros and an empty digest. A null id
    stays null; repeated rows are texts of their own and each is counted. A
    single group of very many tokens costs its distinct ids, not its links. Ties
    for the highest count all count as best. Other input columns play no part;
    an empty table gives none.

    ``a_ranks`` names the first tokenizer's vocabulary for a faster library,
    used for texts that both split alike; None always uses ``a_file`` itself.
    """

    spark = docs.sparkSession
    work = work or Workspace(spark, "alignment")
    files = (a_file, a_ranks, b_file)
    here = coder(*files)
    size_b = here.size_b
    kind = "int" if here.size_a * size_b < 1 << 31 else "long"
    stored = texts_links(docs, files, id_column, text_column, kind)
    stored = work.keep(stored.withColumn("row", F.monotonically_increasing_id()), "texts")
    counts = work.keep(stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")

    # One row for each entry of the first vocabulary at most.
    best = np.zeros(here.size_a, np.int64)
    for r in counts.groupBy(F.floor(F.col("pair") / F.lit(size_b)).cast("int").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r.a] = r.n
    least = _head(counts, head_pairs)
    head = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(head["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((head["pair"].to_numpy()[order].astype(np.int64), head["n"].to_numpy()[order], best))
    some_rare = least > 1

    names = ["row", "n_best", "count_sum", "pairs", "times"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, most = sent.value
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            pairs = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
            times = batch.column(2).values.to_numpy(zero_copy_only=False)
            skip = batch.column(2).offsets.to_numpy()
            times, ends = times[skip[0] : skip[-1]], ends - ends[0]
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n = np.where(found, number[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            is_best = found & (n == most[pairs // size_b])
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best, times * n, ~found)]
            n_best, count_sum = (x[ends[1:]] - x[ends[:-1]] for x in total[:2])
            rest = pa.array(total[2][ends].astype(np.int32))
            left = [pa.ListArray.from_arrays(rest, pa.array(x[~found])) for x in (pairs, times)]
            yield pa.record_batch([batch.column(0), pa.array(n_best), pa.array(count_sum), *left], names=names)

    looked = stored.select("row", "pairs", "times").mapInArrow(
        look_up, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    )
    if some_rare:
        looked = work.keep(looked, "frequent")
        rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*")
        rare = rare.withColumnRenamed("pairs", "pair").join(counts.where(F.col("n") < least), "pair")
        top = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a int, top long"))
        rare = rare.withColumn("a", F.floor(F.col("pair") / F.lit(size_b)).cast("int")).join(top, "a")
        rare = rare.groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
        looked = looked.join(rare, "row", "left").select(
            "row",
            (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        )
    return stored.drop("pairs", "times").join(looked.drop("pairs", "times"), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
