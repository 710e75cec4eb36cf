"""Latest row per key: re-emitted spans and re-written tree nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_TIE_BREAK = ("start_time", "name", "status", "duration_ms", "cost_usd", "parent_span_id")


def last_written_spans(spans: DataFrame, used: tuple[str, ...] = ()) -> DataFrame:
    """One row per span id: the last one to arrive, ids that are NULL left out.

    "Last" is the greatest ``(ingested_at, seq)``; full ties fall to the span's
    own values (``used``: further columns the caller reads) so that the choice
    is the same on every run. Filtering the rank
    to 1 lets Spark cut each key to one row per task before the shuffle, so a
    span re-emitted very many times does not pile up.
    """

    columns = dict.fromkeys(("ingested_at", "seq", *_TIE_BREAK, *used))
    order = [F.col(c).desc_nulls_last() for c in columns]
    return _first(spans.where(F.col("span_id").isNotNull()), order)


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per tree node: its newest version."""

    return _first(nodes, [F.col("written_at").desc_nulls_last(), F.col("order_index").desc_nulls_last()])


def _first(df: DataFrame, order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
