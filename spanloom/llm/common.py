"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space of the contracts: blank, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Text handled at once by vectorised code; bounds a task's arrays.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_prefix(columns: list[str]) -> str:
    """A prefix for helper columns that no input column begins with."""

    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def seeded(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """At most ``count`` of ``rows``, the first in the order of a seeded hash of all columns.

    Only hashes are sorted, so no task gathers whole rows of all partitions;
    rows that tie with the last hash are alike, and the limit bounds them too.
    """

    hashed = rows.withColumn("_o", F.xxhash64(F.lit(seed), *rows.columns))
    last = hashed.select("_o").orderBy("_o").limit(count).agg(F.max("_o")).first()[0]
    return hashed.where(F.lit(False) if last is None else F.col("_o") <= last).drop("_o").limit(count)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Row ranges of a batch with their texts as UTF-8 bytes (null: empty).

    A range holds at most ``limit`` bytes, or one text that alone is longer.
    """

    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
    texts = [t or b"" for t in texts]
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > limit:
            yield slice(first, i), texts[first:i]
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield slice(first, len(texts)), texts[first:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins (with the end)."""

    ends = np.cumsum([0] + [len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends


def byte_symbols() -> dict[str, int]:
    """Byte-level entries: printable bytes stand for themselves, the rest for 256 and on."""

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
