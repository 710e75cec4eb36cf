"""Counters, gauges and the cost histogram kept up to date batch by batch.

What a batch of scored runs adds is one small table of mergeable values: counts
and exact sums by key, and the newest run as a greatest struct. Folding adds it
to the table so far, so a panel reads a row per key however many runs were
scored, and a batch costs what its own runs cost. The sum of the folds equals
one pass over all runs, in whatever order they come.

The table stands under a manifest: the next version replaces the one before and
records the batch, so a batch that is tried again adds nothing and a reader
never sees half of one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanloom.operators import metrics
from spanloom.operators.detect import CRITICAL, RULE_NAMES
from spanloom.plans.scoring import Scored
from spanloom.schema import COST_DECIMAL
from spanloom.sources.versions import TRIES, Version, VersionedTable

FINDINGS, RUNS, NEWEST = "findings", "runs", "newest"
VACUUM = 50  # versions between removals of what no version lists
_KEYS = ("counter", "label", "level", "at")
# Exact sums of run costs; n counts rows.
_RUN = (
    T.StructType().add("last_start", "timestamp").add("trace_id", "string").add("cost", "double")
    .add("loops", "long").add("failures", "long")
)
STATE_SCHEMA = (
    T.StructType().add("counter", "string").add("label", "string").add("level", "string").add("at", "timestamp")
    .add("n", "long").add("amount", T.DecimalType(38, 8)).add("newest", _RUN)
)


def _state(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA])


def added_by(scored: Scored, starts: DataFrame) -> DataFrame:
    """What a batch of scored runs adds: ``STATE_SCHEMA``, a row per key.

    ``starts`` has ``trace_id, last_start`` of the runs. No runs add no rows.
    """

    timed = scored.findings.select("trace_id", "rule", "severity").join(starts, "trace_id", "left")
    day = F.expr("timestamp_seconds(floor(unix_seconds(last_start) / 86400) * 86400)")  # of UTC, in any session
    found = timed.groupBy("rule", "severity", day.alias("at")).agg(F.count("*").alias("n"))

    total, bucket = F.col("total_cost_usd"), F.lit("+Inf")
    for bound in reversed(metrics.COST_BOUNDS):
        bucket = F.when(total <= F.lit(bound).cast(COST_DECIMAL), F.lit(bound)).otherwise(bucket)
    runs = scored.summaries.groupBy(bucket.alias("le")).agg(F.count("*").alias("n"), F.sum(total).alias("s"))

    last = starts.agg(F.max(F.struct("last_start", "trace_id")).alias("x")).select("x.*").where("trace_id IS NOT NULL")
    # One row, so broadcasting it is safe whatever the data.
    gauges = metrics.last_run_gauges(scored.summaries, scored.findings, last).join(F.broadcast(last), "trace_id")
    newest = F.struct("last_start", "trace_id", "last_run_cost_usd", "last_run_loops", "last_run_tool_failures")
    return (
        _state(found, counter=F.lit(FINDINGS), label=F.col("rule"), level=F.col("severity"), at=F.col("at"), n=F.col("n"))
        .unionByName(_state(runs, counter=F.lit(RUNS), label=F.col("le"), n=F.col("n"), amount=F.col("s")))
        .unionByName(_state(gauges, counter=F.lit(NEWEST), newest=newest))
    )


def merged(state: DataFrame) -> DataFrame:
    """A row per key: counts and sums added up, the newest run the greatest by start, then id."""

    return state.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,8)").alias("amount"), F.max("newest").alias("newest"))


class Counters:
    """The folded table at ``path``, and the panels that read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, STATE_SCHEMA)

    def fold(self, scored: Scored, starts: DataFrame, stream: str = "watch", batch: int = 0) -> int | None:
        """Add a batch; None if this ``batch`` of ``stream`` or a later one is in already.

        Another writer that comes first is added to, not overwritten.
        """

        if self._has(self.table.version(), stream, batch):
            return None
        part = self.table.write_part(added_by(scored, starts).coalesce(1))
        added = self.table.read_parts((part,) if part else ())
        for attempt in range(TRIES):
            before = self.table.version()
            if self._has(before, stream, batch):
                return None
            # A row per rule, severity and day: one task writes it.
            whole = merged(self.table.read_parts(before.parts).unionByName(added)).coalesce(1)
            new = self.table.write_part(whole)
            after = Version((new,) if new else (), {**before.batches, stream: batch})
            number = self.table.commit(lambda now: after if now == before else None)
            if number is not None:
                if number % VACUUM == VACUUM - 1:
                    self.table.vacuum()
                return number
            time.sleep(0.05 * attempt)
        raise RuntimeError(f"batch {batch} of {stream} could not be added in {TRIES} tries")

    @staticmethod
    def _has(version: Version, stream: str, batch: int) -> bool:
        return version.batches.get(stream, -1) >= batch

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def _rows(self, counter: str) -> DataFrame:
        return self.read().where(F.col("counter") == counter)

    def findings_by_severity(self, rules=RULE_NAMES) -> DataFrame:
        found = self._rows(FINDINGS).groupBy(F.col("label").alias("rule"), F.col("level").alias("severity"))
        return metrics.on_grid(found.agg(F.sum("n").alias("n")), rules)

    def critical_findings(self) -> DataFrame:
        n = F.sum(F.when(F.col("level") == CRITICAL, F.col("n")))
        return self._rows(FINDINGS).agg(F.coalesce(n, F.lit(0)).alias("critical_findings"))

    def findings_over_time(self) -> DataFrame:
        found = self._rows(FINDINGS).groupBy(F.col("label").alias("rule"), F.col("at").alias("interval_start"))
        return metrics.running_findings(found.agg(F.sum("n").alias("findings")))

    def runs_evaluated(self) -> DataFrame:
        return self._rows(RUNS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("runs_evaluated"))

    def cost_histogram(self) -> DataFrame:
        upto = [
            F.coalesce(F.sum(F.when(F.col("label").isin(*metrics.COST_BOUNDS[: i + 1]), F.col("n"))), F.lit(0)).alias(f"b{i}")
            for i in range(len(metrics.COST_BOUNDS))
        ]
        return metrics.buckets(self._rows(RUNS).agg(*upto, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("amount").alias("s")))

    def last_run_gauges(self) -> DataFrame:
        return self._rows(NEWEST).select(
            F.col("newest.trace_id").alias("trace_id"),
            F.col("newest.cost").alias("last_run_cost_usd"),
            F.col("newest.loops").alias("last_run_loops"),
            F.col("newest.failures").alias("last_run_tool_failures"),
        )
