"""Building blocks that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.session import Workspace

# A list of keys is broadcast only when measured and at most this large.
BROADCAST_BYTES = 32 * 1024 * 1024
# How many ways the long side of a lookup is spread beyond that.
SALTS = 64

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def number_rows(df: DataFrame, order: list[Column], work: Workspace, into: str = "pos") -> DataFrame:
    """Number all rows 1, 2, … in ``order``, without one task seeing them all.

    A window without partitions would do this in a single task. Here the rows
    are range-partitioned and sorted, and the sorted table is written, which
    fixes each row's place; a row's number is its place in its partition plus
    the sizes of the partitions before. ``order`` must be total. Only the sizes
    are broadcast: one row per partition.
    """

    placed = work.keep(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        into,
    )
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), part == F.col("_part"))
        .withColumn(into, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1)
        .drop("_at", "_part", "_start")
    )


def fits_broadcast(keys: DataFrame, key: str) -> bool:
    """Whether a stored list of keys is small enough to send to every executor."""

    size = keys.agg(F.sum(F.octet_length(key) + 32)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def keep_or_drop_keys(df: DataFrame, keys: DataFrame, fits: bool, key: str, keep: bool) -> DataFrame:
    """Rows of ``df`` whose ``key`` is (not) in ``keys``, a list of distinct keys.

    A list that ``fits`` is broadcast. A longer one is repeated once per salt
    and joined on key and salt, so that no key's rows all meet in one task.
    """

    how = "left_semi" if keep else "left_anti"
    if fits:
        return df.join(F.broadcast(keys), key, how)
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A hash, not a random number: a task that is run again must salt alike.
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates ``value`` once per row and uses it in ``body``.

    Inside a lambda, Spark may substitute an expression for a column that is
    referenced once, and then evaluates it for every array element. Binding it
    as a lambda variable prevents that.
    """

    return f"transform(array({value}), {name} -> {body})[0]"
