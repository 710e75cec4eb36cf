"""Depth and path of spans by a recursive query.

A second way to the same places, independent of ``operators.assemble``: spans
are followed from the roots down, one level a step, by Spark's recursive common
table expression. Each step joins the spans found last with their children, so a
deep run costs as many joins as it has levels; ``assemble`` has no such cost and
is the one to use on runs of unknown depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanloom.operators.dedupe import last_written_spans
from spanloom.session import Workspace

MAX_LEVELS = 100


def walked(spans: DataFrame, levels: int = MAX_LEVELS, work: Workspace | None = None) -> DataFrame:
    """(trace_id, span_id, depth, root_id, path) of the spans that a root or an orphan leads to.

    ``path`` has the ids from the root down to the span. Spans of a parent cycle
    and below it lead to no root and are left out. A run with more than ``levels``
    levels below its roots is an error, not a shorter result.

    The walk is stored before this returns: Spark reads its limit on rows when the
    query runs, so the setting has to hold until then. The nodes are stored too,
    as each level reads them.
    """

    spark = spans.sparkSession
    work = work or Workspace(spark, "walk")
    nodes = work.keep(last_written_spans(spans).select("trace_id", "span_id", "parent_span_id"), "nodes")
    row_limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(row_limit)
    # The limit is on rows of all runs together; here only depth is bounded.
    spark.conf.set(row_limit, "-1")
    try:
        found = spark.sql(
            f"""
            WITH RECURSIVE nodes AS (SELECT * FROM {{nodes}}),
            roots AS (
              SELECT n.trace_id, n.span_id FROM nodes n LEFT ANTI JOIN nodes p
              ON p.trace_id = n.trace_id AND p.span_id = n.parent_span_id),
            walk(trace_id, span_id, depth, root_id, path) MAX RECURSION LEVEL {int(levels)} AS (
              SELECT trace_id, span_id, 0, span_id, array(span_id) FROM roots
              UNION ALL
              SELECT c.trace_id, c.span_id, w.depth + 1, w.root_id, array_append(w.path, c.span_id)
              FROM walk w JOIN nodes c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id)
            SELECT * FROM walk
            """,
            nodes=nodes,
        )
        return work.keep(found, "walk")
    finally:
        spark.conf.set(row_limit, before)
