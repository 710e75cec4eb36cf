"""Settle-then-score: check a run once its spans have stopped coming.

Spans of a run arrive over seconds, often the root last. A run is scored when no
span of it has arrived for ``quiet`` time, and only once. Runs that have not
settled yet are kept in a small stored table, one row each: their span count,
last arrival and first and last day. Every batch adds its arrivals, counted per
run before the shuffle, takes out the runs that are quiet by now, and stores the
rest for the next batch.

Nothing is dropped for being late. An arrival that is older than what came
before counts like any other: its run waits in the table until it is quiet, and
a run that was not scored yet is open again. "Now" is the newest arrival seen so
far. ``ticks`` adds empty rows from Spark's rate source, so that the last runs
settle even when the stream goes silent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.config import Thresholds
from spanloom.operators.detect import RULES, Rule
from spanloom.operators.skew import fits_broadcast, keep_or_drop_keys
from spanloom.operators.summary import last_starts
from spanloom.plans.scoring import Scored, publish, score
from spanloom.session import Workspace
from spanloom.sources.tables import ensure_node_table
from spanloom.streaming.counters import Counters

QUIET = "3 seconds"
SCORED_SCHEMA = "trace_id string, scored_at timestamp, batch long"
# A row without a run carries the time of the newest arrival.
PENDING_SCHEMA = "trace_id string, spans long, last_arrival timestamp, first_day date, last_day date, settled boolean"


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """Rows without a run that carry the passing of time."""

    return (
        spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
        .select(F.lit(None).cast("string").alias("trace_id"), F.col("timestamp").alias("ingested_at"))
    )


def settled_runs(arrivals: DataFrame, quiet: str = QUIET, heartbeat: DataFrame | None = None) -> DataFrame:
    """Runs that went quiet: id, spans in the session, time of the last arrival.

    ``arrivals`` is a table or stream with ``trace_id`` and ``ingested_at``. A
    run whose spans pause longer than ``quiet`` appears again. On a stream,
    arrivals must come in order: a watermark drops what is older than the
    newest of an earlier batch. The watch does not depend on this.
    """

    seen = arrivals.select("trace_id", "ingested_at")
    if heartbeat is not None:
        seen = seen.unionByName(heartbeat)
    return (
        seen.withWatermark("ingested_at", "0 seconds")
        .groupBy(F.session_window("ingested_at", quiet).alias("session"), "trace_id")
        .agg(F.count("trace_id").alias("spans"), F.max("ingested_at").alias("last_arrival"))
        # Not "trace_id IS NOT NULL": that would be pushed below the watermark
        # and keep heartbeats from moving it.
        .where("spans > 0")
        .select("trace_id", "spans", "last_arrival")
    )


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED_SCHEMA).parquet(path)


def mark_scored(runs: DataFrame, path: str, batch: int) -> None:
    """Remember runs as scored. A batch that is tried again replaces its own marks."""

    (
        runs.select("trace_id", F.current_timestamp().alias("scored_at"), F.lit(batch).cast("long").alias("batch"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def ignore_existing(spans: DataFrame, path: str) -> None:
    """Mark all runs that exist already, so that only later ones are scored.

    Call once before the first start; a restart keeps its marks.
    """

    mark_scored(spans.select("trace_id").where("trace_id IS NOT NULL").distinct(), path, -1)


def unscored(settled: DataFrame, scored: DataFrame, batch: int) -> DataFrame:
    """Settled runs no earlier batch has scored."""

    earlier = scored.where(F.col("batch") != batch)
    return settled.select("trace_id").distinct().join(earlier, "trace_id", "left_anti")


def _counted(arrivals: DataFrame) -> DataFrame:
    """A batch's arrivals: a row a run, and one without a run for the newest of all."""

    day = F.to_date("start_time") if "start_time" in arrivals.columns else F.lit(None).cast("date")
    seen = arrivals.select("trace_id", "ingested_at", day.alias("day"))
    runs = seen.groupBy("trace_id").agg(
        F.count("*").alias("spans"),
        F.max("ingested_at").alias("last_arrival"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    newest = seen.agg(F.max("ingested_at").alias("last_arrival"))
    return runs.where("trace_id IS NOT NULL").unionByName(newest, allowMissingColumns=True)


class Pending:
    """Runs that have not settled, as a stored table with a version for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(PENDING_SCHEMA).parquet(f"{self.path}/{batch_id}")

    def advance(self, arrivals: DataFrame, scored: DataFrame, batch_id: int, quiet: str) -> DataFrame:
        """Store the next version, and give the runs that have settled.

        A batch that is tried again reads the same earlier version and replaces
        its own. Versions that no retry can ask for are removed.
        """

        rows = _counted(arrivals)
        if self._exists(batch_id - 1):
            rows = rows.unionByName(self.read(batch_id - 1).where("NOT settled").drop("settled"))
        runs = rows.groupBy("trace_id").agg(
            F.sum("spans").alias("spans"),
            F.max("last_arrival").alias("last_arrival"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
        now = rows.agg(F.max("last_arrival")).first()[0]
        calm = F.col("last_arrival") + F.expr(f"INTERVAL {quiet}") <= F.lit(now)
        settled = F.coalesce(F.col("trace_id").isNotNull() & calm, F.lit(False))
        # Marks are joined only to the runs at hand, which the clock row outlives.
        waiting = runs.join(scored.where(F.col("batch") != batch_id), "trace_id", "left_anti")
        waiting.withColumn("settled", settled).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        self._remove(batch_id - 2)
        return self.read(batch_id).where("settled")

    def _place(self, batch_id: int):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch_id}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, batch_id: int) -> bool:
        fs, place = self._place(batch_id)
        return fs.exists(place)

    def _remove(self, batch_id: int) -> None:
        fs, place = self._place(batch_id)
        fs.delete(place, True)


def start_watch(
    arrivals: DataFrame,
    read_spans: Callable[[object, object], DataFrame],
    scored_path: str,
    node_path: str,
    finding_path: str,
    checkpoint: str,
    limits: Thresholds = Thresholds(),
    on_scored: Callable[[Scored, int], None] | None = None,
    quiet: str = QUIET,
    every: str = QUIET,
    once: bool = False,
    rules: tuple[Rule, ...] = RULES,
    summary_path: str | None = None,
    counter_path: str | None = None,
) -> StreamingQuery:
    """Score settled runs batch by batch, all runs of a batch in one plan.

    ``arrivals`` is a stream of spans (``trace_id``, ``ingested_at`` and, to
    prune by day, ``start_time``), ticks among them if wanted. ``read_spans``
    gives the span table as it is now, between two days if they are not None, and
    spans without a start whatever the days.
    Summaries are stored at ``summary_path`` by batch, replaced on a retry, so
    that counters and histograms need not go back to spans; at ``counter_path``
    counters are folded batch by batch (``streaming/counters``). ``on_scored``
    receives each batch's results.
    """

    spark = arrivals.sparkSession
    ensure_node_table(spark, node_path)
    mark_scored(spark.createDataFrame([], "trace_id string"), scored_path, -2)
    pending = Pending(spark, f"{checkpoint.rstrip('/')}-pending")

    def handle(batch: DataFrame, batch_id: int) -> None:
        settled = pending.advance(batch, read_scored(spark, scored_path), batch_id, quiet)
        days = settled.agg(F.min("first_day"), F.max("last_day"), F.count("*")).first()
        if not days[2]:
            return
        mark_scored(settled, scored_path, batch_id)
        due = settled.select("trace_id")
        spans = keep_or_drop_keys(read_spans(days[0], days[1]), due, fits_broadcast(due, "trace_id"), "trace_id", keep=True)
        work = Workspace(spark, "watch")
        try:
            scored = score(spans, limits, rules=rules, work=work)
            publish(scored, node_path, finding_path, batch_id, rules, summary_path, stream="watch")
            if counter_path is not None:
                Counters(spark, counter_path).fold(scored, last_starts(spans), "watch", batch_id)
            if on_scored is not None:
                on_scored(scored, batch_id)
        finally:
            work.drop()

    writer = arrivals.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.queryName("spanloom-watch").start()


def late_spans(spans: DataFrame, scored: DataFrame) -> DataFrame:
    """Per run, spans that arrived after it was scored; they stay unscored."""

    return (
        spans.join(scored.groupBy("trace_id").agg(F.min("scored_at").alias("scored_at")), "trace_id")
        .where(F.col("ingested_at") > F.col("scored_at"))
        .groupBy("trace_id")
        .agg(F.count("*").alias("late_after_score"))
    )
