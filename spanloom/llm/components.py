"""Connected components of an edge table by alternating star contractions.

Each round is two joins on a vertex and its smallest neighbour; minima are
aggregated on the map side, so a vertex with very many edges costs one row a
task. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.session import Workspace

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller end."""

    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(a, b): each vertex but the smallest of its component, with that smallest one.

    ``edges`` has long columns a and b in any direction; self-loops are ignored.
    """

    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = work.keep(now, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now
        seen = tuple(mark)
        large = _large_star(now).where("a != b").distinct()
        small = _small_star(large).where("a != b").distinct()
        now = work.keep(small, "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
