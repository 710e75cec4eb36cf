"""Per-run rollups over raw spans: every copy of a span counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.timing import micros, own_duration_ms
from spanloom.schema import COST_DECIMAL, TIME_DECIMAL, conform


def run_summaries(spans: DataFrame) -> DataFrame:
    """One row per run: cost, tokens, time, steps, errors, agents, bounds.

    One grouped aggregation. Partial sums are made before the shuffle, so a run
    with very many spans arrives as one row per task (times its agents). Costs
    that are no number or too large for an exact sum are left out of the total
    and counted in ``unusable_costs``.
    """

    spans = conform(spans)
    took = own_duration_ms(F.col("duration_ms"), F.col("start_time"), F.col("end_time"))
    agent = F.when(F.col("agent_name") != "", F.col("agent_name"))
    # NaN, infinite and overflowing costs become NULL here.
    exact = F.col("cost_usd").try_cast(COST_DECIMAL)
    totals = spans.groupBy("trace_id").agg(
        F.coalesce(F.sum(exact), F.lit(0)).alias("total_cost_usd"),
        F.count_if(F.col("cost_usd").isNotNull() & exact.isNull()).alias("unusable_costs"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("total_tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("total_tokens_out"),
        F.sum(took.cast(TIME_DECIMAL)).cast("double").alias("sum_step_ms"),
        F.count("*").alias("step_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_distinct(agent).alias("agent_count"),
        F.min("start_time").alias("start_time"),
        F.max("start_time").alias("_last_start"),
        F.max("end_time").alias("_last_end"),
    )
    # Without any end the last start closes the run; without any start there
    # are no bounds at all.
    end = F.when(F.col("start_time").isNotNull(), F.coalesce("_last_end", "_last_start"))
    wall = F.greatest(F.lit(0.0), (micros(end) - micros(F.col("start_time"))) / F.lit(1000.0))
    return totals.select(
        "trace_id",
        "total_cost_usd",
        "total_tokens_in",
        "total_tokens_out",
        (F.col("total_tokens_in") + F.col("total_tokens_out")).alias("total_tokens"),
        F.coalesce(wall, F.lit(0.0)).alias("wall_clock_ms"),
        "sum_step_ms",
        "step_count",
        "error_count",
        "agent_count",
        "start_time",
        end.alias("end_time"),
        "unusable_costs",
    )


def last_starts(spans: DataFrame) -> DataFrame:
    """Newest start per run."""

    return spans.groupBy("trace_id").agg(F.max("start_time").alias("last_start"))


def recent_runs(spans: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` newest runs, oldest of them first."""

    newest = (
        last_starts(spans)
        .orderBy(F.col("last_start").desc_nulls_last(), F.col("trace_id").desc())
        .limit(limit)
    )
    return newest.orderBy(F.col("last_start").asc_nulls_first(), "trace_id")


def orphan_ids(nodes: DataFrame) -> DataFrame:
    """Orphaned spans, one row each; ``order_index`` gives their order in a run."""

    return nodes.where("orphaned").select("trace_id", "span_id", "parent_span_id", "order_index")
