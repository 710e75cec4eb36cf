"""Settle-then-score with timers in Spark's state store.

The watch in ``streaming.watch`` keeps open runs in a stored table and rewrites
it with each batch, so a batch costs as much as there are open runs. Here they
are in RocksDB, with processing-time timers: an arrival touches the open runs of
its own bucket only, a run settles when its timer fires, whatever other runs do,
and silence settles the last runs without ticks. A retried batch starts from the
state that the batch before left.

Every call from Python to the state store takes a trip to the JVM and back, far
longer than the work on one run. So runs are dealt to ``BUCKETS`` buckets by a
hash: a bucket's open runs are one value of arrays, read and written once a batch,
and its runs of one deadline share one timer.

A run that was scored keeps a mark in the state, so stragglers count as late and
are not scored again. Marks pile up, so a bucket keeps them in ``SLOTS`` values by
another part of the hash, of which arrivals touch their own runs' only. A mark
expires ``remember`` after the scoring or the last late span if that is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanloom.config import Thresholds
from spanloom.operators.detect import RULES, Rule
from spanloom.operators.skew import fits_broadcast, keep_or_drop_keys
from spanloom.plans.scoring import Scored, publish, score
from spanloom.session import Workspace
from spanloom.sources.tables import ensure_node_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed: a checkpoint's runs lie in the buckets and slots they were dealt to.
BUCKETS, SLOTS = 1024, 64
# Open runs of a bucket, one element a run. Times are microseconds, days count from 1970, timers are milliseconds.
RUN_STATE = (
    "trace_id array<string>, spans array<long>, last_arrival array<long>, "
    "first_day array<int>, last_day array<int>, slot array<int>, timer array<long>"
)
# Marks of a slot, one element a run, in the same units; a mark without ``until`` stays.
MARK_STATE = "trace_id array<string>, scored_at array<long>, late array<long>, until array<long>"
SETTLED = "trace_id string, spans long, last_arrival long, first_day int, last_day int"
STREAM = "timers"

# Stand for a missing time and day: nulls would make pandas turn integers into floats.
_NO_TIME, _NO_DAY = -(1 << 63), -(1 << 31)


class SettleRuns(StatefulProcessor):
    """State and timers of a bucket of runs; gives the runs whose timer fires."""

    def __init__(self, quiet_ms: int, remember_ms: int | None = None):
        self.quiet_ms, self.remember_ms = quiet_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE)
        self.mark = handle.getMapState("mark", "slot int", MARK_STATE, ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        arrived, slots = {}, {}
        for batch in rows:
            for run, slot, at, day in zip(*(batch[c].tolist() for c in ("trace_id", "slot", "last_arrival", "day"))):
                one = (1, None if at == _NO_TIME else at, *(None if day == _NO_DAY else day,) * 2)
                arrived[run], slots[run] = _together(arrived[run], one) if run in arrived else one, slot
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.mark.exists():
            for slot, runs in _by_slot(slots).items():
                marks = self._marks(slot, now)
                if late := [run for run in runs if run in marks]:
                    for run in late:
                        scored_at, before, _ = marks[run]
                        marks[run] = (scored_at, before + arrived.pop(run)[0], self._until(now))
                    self._keep_marks(slot, marks)
        if not arrived:
            return
        timer = now + self.quiet_ms
        waiting = self._open()
        before = {of[-1] for of in waiting.values()}
        for run, came in arrived.items():
            waiting[run] = (*(_together(waiting[run], came) if run in waiting else came), slots[run], timer)
        after = {of[-1] for of in waiting.values()}
        for gone in before - after:
            self.handle.deleteTimer(gone)
        for new in after - before:
            self.handle.registerTimer(new)
        self._keep(waiting)
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        fired, waiting = expiredTimerInfo.getExpiryTimeInMs(), self._open()
        settled = {run: of for run, of in waiting.items() if of[-1] <= fired}
        if not settled:
            return
        self._keep({run: of for run, of in waiting.items() if of[-1] > fired})
        now = timerValues.getCurrentProcessingTimeInMs()
        for slot, runs in _by_slot({run: of[-2] for run, of in settled.items()}).items():
            self._keep_marks(slot, self._marks(slot, now) | dict.fromkeys(runs, (now * 1000, 0, self._until(now))))
        rows = zip(*((run, *of[:-2]) for run, of in settled.items()))
        names = ("trace_id", "spans", "last_arrival", "first_day", "last_day")
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, rows)})

    def _open(self) -> dict[str, tuple]:
        """Spans, last arrival, first and last day, slot and timer by run."""

        return {run: of for run, *of in zip(*(self.run.get() or ()))}

    def _keep(self, waiting: dict[str, tuple]) -> None:
        if waiting:
            self.run.update(([*waiting], *map(list, zip(*waiting.values()))))
        else:
            self.run.clear()

    def _marks(self, slot: int, now: int) -> dict[str, tuple]:
        """Moment of scoring, late spans and end by run, of marks that have not expired."""

        found = zip(*(self.mark.getValue((slot,)) or ()))
        return {run: (at, late, until) for run, at, late, until in found if until is None or until > now}

    def _keep_marks(self, slot: int, marks: dict[str, tuple]) -> None:
        self.mark.updateValue((slot,), ([*marks], *map(list, zip(*marks.values()))))

    def _until(self, now: int) -> int | None:
        return None if self.remember_ms is None else now + self.remember_ms

    def close(self) -> None:
        pass


def _by_slot(slots: dict[str, int]) -> dict[int, list[str]]:
    runs = {}
    for run, slot in slots.items():
        runs.setdefault(slot, []).append(run)
    return runs


def _together(a: tuple, b: tuple) -> tuple:
    """Spans, last arrival, first and last day of two sets of a run's arrivals."""

    either = lambda pick, x, y: y if x is None else x if y is None else pick(x, y)
    return a[0] + b[0], either(max, a[1], b[1]), either(min, a[2], b[2]), either(max, a[3], b[3])


def settled_by_timer(arrivals: DataFrame, quiet: timedelta, remember: timedelta | None = None) -> DataFrame:
    """Runs of a stream of spans, each once, when nothing has come for ``quiet``.

    ``arrivals`` has ``trace_id``, ``ingested_at`` and, to prune by day,
    ``start_time``. Rows without a run are passed over. Needs the RocksDB state
    store (``use_rocksdb``).
    """

    day = F.unix_date(F.to_date("start_time")) if "start_time" in arrivals.columns else F.lit(None)
    # One row an arrival: a batch's rows of a run meet in its state's partition.
    place = F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS * SLOTS))
    rows = arrivals.where("trace_id IS NOT NULL").select(
        (place % BUCKETS).cast("int").alias("bucket"),
        F.floor(place / BUCKETS).cast("int").alias("slot"),
        "trace_id",
        F.coalesce(F.unix_micros("ingested_at"), F.lit(_NO_TIME)).alias("last_arrival"),
        F.coalesce(day, F.lit(_NO_DAY)).alias("day"),
    )
    millis = lambda span: None if span is None else int(span.total_seconds() * 1000)
    settled = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SettleRuns(millis(quiet), millis(remember)),
        outputStructType=SETTLED,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return settled.selectExpr(*_SHOWN)


# A run's columns, back from numbers to times and days.
_SHOWN = (
    "trace_id",
    "spans",
    "timestamp_micros(last_arrival) AS last_arrival",
    "date_from_unix_date(first_day) AS first_day",
    "date_from_unix_date(last_day) AS last_day",
)


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need it; queries started before keep what they had."""

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_timed_watch(
    arrivals: DataFrame,
    read_spans: Callable[[object, object], DataFrame],
    node_path: str,
    finding_path: str,
    checkpoint: str,
    quiet: timedelta,
    every: str = "3 seconds",
    limits: Thresholds = Thresholds(),
    rules: tuple[Rule, ...] = RULES,
    summary_path: str | None = None,
    on_scored: Callable[[Scored, int], None] | None = None,
    remember: timedelta | None = None,
) -> StreamingQuery:
    """Score runs as their timers fire, all runs of a batch in one plan.

    Results are stored by batch and replaced on a retry, which gets the same runs
    again: a batch's clock is in its offset log and the state is versioned.
    ``read_spans`` gives the span table as it is now, between two days if they are
    not None, and spans without a start whatever the days.
    """

    spark = arrivals.sparkSession
    use_rocksdb(spark)
    ensure_node_table(spark, node_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        work = Workspace(spark, "timers")
        try:
            settled = work.keep(batch, "settled")
            first, last, runs = settled.agg(F.min("first_day"), F.max("last_day"), F.count("*")).first()
            if not runs:
                return
            due = settled.select("trace_id")
            spans = _spans_of(due, read_spans(first, last), work)
            scored = score(spans, limits, rules=rules, work=work)
            publish(scored, node_path, finding_path, batch_id, rules, summary_path, stream=STREAM)
            if on_scored is not None:
                on_scored(scored, batch_id)
        finally:
            work.drop()

    writer = settled_by_timer(arrivals, quiet, remember).writeStream.foreachBatch(handle).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).queryName(f"spanloom-{STREAM}").start()


def _spans_of(due: DataFrame, spans: DataFrame, work: Workspace) -> DataFrame:
    """The spans of stored run ids, for scoring, which reads them several times.

    Where the ids are too many to broadcast, one join without salts deals the spans
    out by run, and its rows are stored: as nothing else is in that job, adaptive
    skew handling may split a run with very many spans.
    """

    if fits_broadcast(due, "trace_id"):
        return keep_or_drop_keys(spans, due, True, "trace_id", keep=True)
    return work.keep(spans.join(due.hint("shuffle_hash"), "trace_id", "left_semi"), "spans")


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(trace_id, spans, last_arrival, ...): runs that have not settled, from the state of the last batch."""

    buckets = _state(spark, checkpoint, "run").select("value.*")
    return buckets.select(F.inline(F.arrays_zip(*buckets.columns))).selectExpr(*_SHOWN)


def scored_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(trace_id, scored_at, late): runs that were scored, and their spans that came later."""

    marks = _state(spark, checkpoint, "mark")
    # With an expiry the value is wrapped once more.
    slots = marks.select("user_map_value.value.*" if "ttlExpirationMs" in marks.schema["user_map_value"].dataType.names else "user_map_value.*")
    marks = slots.select(F.inline(F.arrays_zip(*slots.columns))).where("until IS NULL OR until > unix_millis(current_timestamp())")
    return marks.select("trace_id", F.timestamp_micros("scored_at").alias("scored_at"), "late")


def wait_until_scored(query: StreamingQuery, spark: SparkSession, checkpoint: str, runs: int, batches: int) -> None:
    """Return when ``runs`` runs are scored and stored, ``batches`` batches of input taken; raise if the query fails.

    The state is that of the last finished batch, whose findings are stored, so a
    batch under way needs no waiting for: timers make batches follow each other
    without a pause. What the caller's stop breaks off then has nothing to store.
    """

    while not query.awaitTermination(1):
        if query.lastProgress and query.lastProgress["batchId"] >= batches and scored_runs(spark, checkpoint).count() >= runs:
            return
    raise RuntimeError(f"{query.name} was stopped before {runs} runs were scored")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
