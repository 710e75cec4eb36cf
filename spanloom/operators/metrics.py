"""Counters, gauges and the cost histogram over scored runs.

Labels are bounded to rule and severity; run ids never become a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators.detect import CRITICAL, FAILURE, LOOP, RULE_NAMES, SEVERITIES
from spanloom.schema import COST_DECIMAL

# Upper bounds of the run cost histogram, in USD.
COST_BOUNDS = ("0.01", "0.05", "0.1", "0.25", "0.5", "1.0", "2.0", "5.0", "10.0")


def findings_by_severity(findings: DataFrame, rules=RULE_NAMES) -> DataFrame:
    """Findings per rule and severity, combinations without any shown as 0.

    ``rules`` are the rules (or their names) that always show; further rules
    show with the severities they have.
    """

    return on_grid(findings.groupBy("rule", "severity").agg(F.count("*").alias("n")), rules)


def on_grid(counted: DataFrame, rules=RULE_NAMES) -> DataFrame:
    """``rule, severity, n`` with the rows of ``rules`` that have none as 0."""

    spark = counted.sparkSession
    # The grid has one row per rule and severity, whatever the data.
    names = [getattr(r, "name", r) for r in rules]
    grid = spark.createDataFrame([(r, s) for r in names for s in SEVERITIES], "rule string, severity string")
    return grid.join(counted, ["rule", "severity"], "full").select(
        "rule", "severity", F.coalesce("n", F.lit(0)).cast("long").alias("findings")
    )


def critical_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == CRITICAL).alias("critical_findings"))


def runs_evaluated(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count("*").alias("runs_evaluated"))


def cost_histogram(summaries: DataFrame) -> DataFrame:
    """Cumulative buckets of run costs, with count and sum, in one aggregation."""

    total = F.col("total_cost_usd")
    counts = [F.count_if(total <= F.lit(b).cast(COST_DECIMAL)).alias(f"b{i}") for i, b in enumerate(COST_BOUNDS)]
    totals = summaries.agg(*counts, F.count("*").alias("n"), F.sum(total).alias("s"))
    return buckets(totals)


def buckets(totals: DataFrame) -> DataFrame:
    """One row of cumulative counts ``b0..``, count ``n`` and sum ``s`` as a row per bucket."""

    shown = [
        F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("runs")) for i, b in enumerate(COST_BOUNDS)
    ]
    shown.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("runs")))
    return totals.select(
        F.inline(F.array(*shown)), F.col("n").alias("run_count"), F.col("s").cast("double").alias("cost_sum")
    )


def last_run_gauges(summaries: DataFrame, findings: DataFrame, newest: DataFrame) -> DataFrame:
    """Cost and worst loop and failure counts of the newest run, 0 where none.

    ``newest`` has ``trace_id, last_start``; ties go to the greatest run id.
    """

    last = newest.orderBy(F.col("last_start").desc_nulls_last(), F.col("trace_id").desc()).limit(1)
    # One row, so broadcasting it is safe whatever the data.
    cost = summaries.join(F.broadcast(last), "trace_id").select("trace_id", "total_cost_usd")
    worst = (
        findings.join(F.broadcast(last), "trace_id", "left_semi")
        .groupBy("trace_id")
        .agg(
            F.max(F.when(F.col("rule") == LOOP, F.col("count"))).alias("loops"),
            F.max(F.when(F.col("rule") == FAILURE, F.col("count"))).alias("failures"),
        )
    )
    return cost.join(worst, "trace_id", "left").select(
        "trace_id",
        F.col("total_cost_usd").cast("double").alias("last_run_cost_usd"),
        F.coalesce("loops", F.lit(0)).cast("long").alias("last_run_loops"),
        F.coalesce("failures", F.lit(0)).cast("long").alias("last_run_tool_failures"),
    )


def findings_over_time(findings: DataFrame, seen: DataFrame, every: str = "1 day") -> DataFrame:
    """Findings per rule, added up over time.

    ``seen`` gives each run's time as ``trace_id, last_start``. The running sum
    works on one row per rule and interval, not on findings. Runs without a
    time form an interval of their own, NULL, before all others.
    """

    timed = findings.join(seen, "trace_id", "left").select("rule", "last_start")
    step = F.window("last_start", every).getField("start")
    dated = timed.where("last_start IS NOT NULL").select("rule", step.alias("interval_start"))
    undated = timed.where("last_start IS NULL").select("rule", F.col("last_start").alias("interval_start"))
    counted = dated.unionByName(undated).groupBy("rule", "interval_start").agg(F.count("*").alias("findings"))
    return running_findings(counted)


def running_findings(counted: DataFrame) -> DataFrame:
    """``rule, interval_start, findings`` with ``findings_total``, the sum up to the interval."""

    upto = Window.partitionBy("rule").orderBy("interval_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counted.withColumn("findings_total", F.sum("findings").over(upto))


def run_costs_over_time(summaries: DataFrame, ordered: bool = False) -> DataFrame:
    """What each run cost at its end; sorted for display only if asked for."""

    rows = summaries.select(
        F.col("end_time").alias("time"), "trace_id", F.col("total_cost_usd").cast("double").alias("run_cost_usd")
    )
    return rows.orderBy("time", "trace_id") if ordered else rows


def alarm_level(value: Column, orange: float | None, red: float) -> Column:
    level = F.when(value >= red, F.lit("red"))
    if orange is not None:
        level = level.when(value >= orange, F.lit("orange"))
    return level.otherwise(F.lit("green"))


def alarm_levels(criticals: DataFrame, gauges: DataFrame) -> DataFrame:
    """Traffic lights of the four headline numbers (two one-row inputs)."""

    both = criticals.unionByName(gauges, allowMissingColumns=True)
    numbers = ("critical_findings", "last_run_cost_usd", "last_run_loops", "last_run_tool_failures")
    # Where each number turns orange and red.
    return both.agg(*[F.max(c).alias(c) for c in numbers]).select(
        alarm_level(F.col("critical_findings"), None, 1).alias("critical_findings"),
        alarm_level(F.col("last_run_cost_usd"), None, 1).alias("last_run_cost"),
        alarm_level(F.col("last_run_loops"), 5, 10).alias("last_run_loops"),
        alarm_level(F.col("last_run_tool_failures"), 3, 6).alias("last_run_tool_failures"),
    )
