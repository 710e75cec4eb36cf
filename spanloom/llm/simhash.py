"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2k bits of each other have a common variant within k
bits of both. Every distinct fingerprint therefore emits all variants within
half the radius; equal variants meet in a shuffle, and the pairs that meet are
verified by their bit distance.

The shuffle goes by a part of the variant: its exclusive-or fold to a few bits.
The fold is linear, so the folds of all 2,081 variants of a 64-bit fingerprint
at k = 2 take only 1 + r + r(r-1)/2 values for a fold of r bits. A fingerprint
is sent once to each of those, and the receiver forms the variants of its own
fold: the same variants meet, at 8 bytes for each fold and not for each variant.
Within a fold, members of one variant are linked in a chain (all of them are
within 2k bits of each other), so copies and hot variants make no pairs, and
each task sends on a spanning forest of its links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import chunks
from spanloom.llm.components import components
from spanloom.session import Workspace

SHINGLE = 4  # words
DISTANCE = 4  # bits
HASH_SEED = 42
BITS = 64
FOLDS = ((8, 1_000_000), (16, 250_000_000), (32, None))  # bits of the fold, up to so many fingerprints
VARIANTS_AT_ONCE = 4_000_000

LAST_ID = (1 << 63) - 1  # rows without an id come last

_FP = pa.schema([("_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; without words it is 0."""

    words = text.lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, HASH_SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], HASH_SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, th, fp): the signed 64-bit fingerprint of each row's whole text, and the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "t"):
                fps = np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], pa.array(fps)], schema=_FP)

    text = F.col(text_column).cast("string")
    given = docs.select(F.col(id_column).cast("long").alias("_id"), _text_hash(text).alias("th"), text.alias("t"))
    return given.mapInArrow(run, "_id long, th long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def errors(radius: int) -> np.ndarray:
    """All 64-bit words of at most ``radius`` set bits."""

    words = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return np.array(words, np.uint64)


def fold(values: np.ndarray, bits: int) -> np.ndarray:
    width = BITS
    while width > bits:
        width //= 2
        values = (values ^ (values >> np.uint64(width))) & np.uint64((1 << width) - 1)
    return values


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the links but the least of its part, with a smaller one of the part."""

    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rest = root != np.arange(len(names))
    return names[rest], names[root[rest]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` bits (even).

    ``distinct`` has one row for each fingerprint, in a long column fp.
    """

    if distance % 2:
        raise ValueError("the distance is twice the radius of a ball: it must be even")
    n = distinct.count()
    bits = next(b for b, most in FOLDS if most is None or n <= most)
    near = errors(distance // 2)
    near_folds = fold(near, bits)
    patterns = np.unique(near_folds)
    by_pattern = {int(p): near[near_folds == p] for p in patterns}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            goes = (fold(fps, bits)[:, None] ^ patterns[None, :]).ravel()
            order = np.argsort(goes, kind="stable")
            goes, sent = goes[order], np.repeat(fps, len(patterns))[order]
            cuts = np.flatnonzero(np.diff(goes)) + 1 if len(goes) else []
            blocks = [x.tobytes() for x in np.split(sent, cuts)] if len(goes) else []
            folds = goes[np.r_[0, cuts].astype(int)].astype(np.int64) if len(goes) else []
            yield pa.record_batch([pa.array(folds, pa.int64()), pa.array(blocks, pa.binary())], names=["fold", "block"])

    def met(fps: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = fold(fps, bits) ^ np.uint64(at)
        variants, owners = [], []
        for pattern, words in by_pattern.items():
            some = fps[own == pattern]
            variants.append((some[:, None] ^ words[None, :]).ravel())
            owners.append(np.repeat(some, len(words)))
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        # Equal variants share a remainder: parts of bounded size, one after the other.
        parts = -(-len(variants) // VARIANTS_AT_ONCE)
        part = (variants * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) if parts > 1 else None
        for k in range(parts):
            v, o = (variants, owners) if part is None else (variants[part == k], owners[part == k])
            order = np.argsort(v)
            v, o = v[order], o[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            a, b = o[same], o[same + 1]
            right = np.bitwise_count(a ^ b) <= distance  # the verification
            if right.any():
                yield _forest(a[right], b[right])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), np.uint64)
        for a, b in met(fps, key[0].as_py()):
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    blocks = distinct.select("fp").mapInArrow(send, "fold long, block binary")
    return blocks.groupBy("fold").applyInArrow(meet, "a long, b long").distinct()


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    work: Workspace | None = None,
) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and its class.

    The class is the smallest id reachable over links of at most ``distance``
    bits, the row's own fingerprint included. A null text counts as empty (its
    fingerprint is 0); a null id never names a class unless the class has no
    other. Repeated rows come back as often as they come. Other input columns
    play no part. An empty table gives an empty result.
    """

    rows, classes = _classes(docs, id_column, text_column, shingle, distance, work)
    component = F.col("first.id").alias("component")
    return rows.join(classes, "fp").select(F.col("_id").alias("id"), "fp", component)


def _classes(docs, id_column, text_column, shingle, distance, work) -> tuple[DataFrame, DataFrame]:
    """Rows with fingerprints, and for each fingerprint its class's root and first row (by id, then text)."""

    work = work or Workspace(docs.sparkSession, "simhash")
    rows = work.keep(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "th")
    distinct = work.keep(rows.groupBy("fp").agg(F.min(rank).alias("least")), "distinct")
    stars = components(links(distinct, distance), work)
    named = distinct.join(stars, distinct.fp == stars.a, "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    # Stored, so that the join with all rows is one that splits a fingerprint held by very many.
    return rows, work.keep(named.join(first, "root").select("fp", "root", "first"), "classes")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each class, with the columns of ``docs``: that with the smallest id.

    Rows without an id come last. Rows are told apart by id and text; of rows
    equal in both, one stays where theirs is the one to stay. Texts of any length
    count whole. An empty table gives an empty result.
    """

    rows, classes = _classes(docs, id_column, text_column, SHINGLE, DISTANCE, None)
    key = F.coalesce(F.col("id"), F.lit(LAST_ID)).alias("key")
    stay = classes.select("root", "first.*").distinct().select(key, "th")
    text = F.col(text_column).cast("string")
    given = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("key"), _text_hash(text).alias("th"), F.struct(*docs.columns).alias("row")
    )
    return given.join(stay, ["key", "th"], "left_semi").dropDuplicates(["key", "th"]).select("row.*")
