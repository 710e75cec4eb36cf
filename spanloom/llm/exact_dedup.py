"""Exact duplicates by a distributed content sort.

Texts are equal when they are the same after each run of white space became one
blank. Rows are dealt into ranges of (text prefix, text hash, id) at splitters
taken from a sample, sorted within their range by the whole text, and
neighbours are compared in full. A range may begin inside a group of copies, so
a group as large as a third of all rows is spread over many tasks; only a text
that a splitter touches can be spread so, and for those few texts the smallest
id and the size are added up beforehand, with map-side sums.

Everything is a DataFrame function: no Python runs on the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import SPACES, text_or_empty

PREFIX = 48  # code points of a text in a splitter, which the driver holds
SAMPLES = 16  # sampled rows a range
ROWS_A_RANGE = 50_000
MOST_RANGES = 4_096  # beyond, ranges grow, which external sorting takes care of
SEED = 11
LAST_ID = (1 << 63) - 1  # rows without an id come last

_KEY = "struct<p:string,h:bigint,i:bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _key(norm: Column, id_column: str) -> Column:
    return F.struct(
        F.substring(norm, 1, PREFIX).alias("p"),
        F.xxhash64(norm).alias("h"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("i"),
    )


def _splitters(docs: DataFrame, norm: Column, id_column: str, ranges: int, rows: int) -> list[tuple]:
    """Sorted keys that cut a seeded sample into equal parts; at most ``ranges`` - 1."""

    share = min(1.0, 1.5 * SAMPLES * ranges / max(rows, 1))
    sample = docs if share >= 1 else docs.sample(share, SEED)
    drawn = (
        sample.select(_key(norm, id_column).alias("k"))
        .select("k", F.xxhash64("k").alias("o"))
        .orderBy("o")
        .limit(2 * SAMPLES * ranges)
        .select("k.*")
        .collect()
    )
    keys = sorted((r.p.encode(), r.h, r.i) for r in drawn)
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    return [(p.decode(), h, i) for p, h, i in cuts]


def _literal(rows: list[dict], kind: str) -> Column:
    """A constant array, folded once by the optimizer."""

    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _range_of(key: Column, cuts: list[tuple]) -> Column:
    """How many splitters are at most ``key``: a binary search in a constant array."""

    if not cuts:
        return F.lit(0)
    array = _literal([{"p": p, "h": h, "i": i} for p, h, i in cuts], _KEY)
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]

    def search(k: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            there = F.try_element_at(array, at + width)
            return F.when(there.isNotNull() & (there <= k), at + width).otherwise(at)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)

    # Bound as a lambda variable: else the key would be built anew for each step.
    return F.transform(F.array(key), search)[0]


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    One row per input row, with all input columns (an input column of one of
    those four names is replaced). Of equal texts the smallest id stays; a null
    text counts as empty; a null id is larger than any other; of rows equal in
    text and id exactly one stays. An empty table gives an empty result.
    """

    ours = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*ours)
    # Input columns travel in one struct, so that none can clash with a helper.
    given = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"), F.struct(*docs.columns).alias("row"))
    norm = normalised(F.col("text"))
    rows = docs.count()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(8 * tasks, min(MOST_RANGES, -(-rows // ROWS_A_RANGE)))
    cuts = _splitters(given.select("id", "text"), norm, "id", ranges, rows)

    keyed = given.withColumn("key", _key(norm, "id"))
    at_cut = F.lit(False)
    if cuts:
        hashes = F.from_json(F.lit(json.dumps(sorted({h for _, h, _ in cuts}))), "array<bigint>")
        at_cut = F.array_contains(hashes, F.col("key.h"))
    # Whole groups of the texts that a splitter touches: at most one hash a splitter.
    spread = (
        keyed.where(at_cut)
        .groupBy(F.sha2(F.encode(norm, "utf-8"), 256).alias("text_sha256"))
        .agg(F.min("id").alias("least"), F.count("*").alias("all"))
    )

    dealt = keyed.select("id", "row", _range_of(F.col("key"), cuts).alias("range"))
    whole = F.coalesce(F.col("row")[text_column], F.lit(""))
    sorted_rows = dealt.repartition("range").withColumn("norm", normalised(whole))
    equal = Window.partitionBy("range", "norm")
    by_id = equal.orderBy(F.col("id").asc_nulls_last())
    found = (
        sorted_rows.withColumn("place", F.row_number().over(by_id))
        .withColumn("here", F.count("*").over(equal))
        .withColumn("first", F.min("id").over(equal))
        .select("id", "row", "place", "here", "first", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256"))
    )
    keep = F.when(F.col("all").isNull(), F.col("first")).otherwise(F.col("least")).alias("keep_id")
    size = F.coalesce("all", "here").alias("group_size")
    marked = found.join(F.broadcast(spread), "text_sha256", "left").select("id", "row", "place", keep, size, "text_sha256")
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return marked.select("row.*", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""

    return mark_copies(docs, id_column, text_column).where("kept").select(*docs.columns)
