"""Streaming ingest and the settle-then-score watch, over file streams."""

import json
import time
from collections import Counter
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spans import at, frame, span
from spanloom.operators import skew
from spanloom.operators.metrics import runs_evaluated
from spanloom.plans import queries
from spanloom.schema import SPAN_SCHEMA
from spanloom.session import Workspace
from spanloom.sources import tables
from spanloom.sources.messages import decode
from spanloom.streaming import timers
from spanloom.streaming.ingest import start_ingest, without_repeats
from spanloom.streaming.timers import open_runs, scored_runs, settled_by_timer, start_timed_watch, use_rocksdb
from spanloom.streaming.watch import (
    SCORED_SCHEMA, Pending, ignore_existing, late_spans, mark_scored, read_scored, settled_runs, start_watch, ticks,
)


def message(i, **fields):
    body = {
        "trace_id": "t", "span_id": f"s{i}", "service_name": "svc", "agent_name": "a", "step_type": "decision",
        "name": "n", "start_time": f"2026-01-0{1 + i % 2}T12:00:00Z", "status": "ok", **fields,
    }
    return json.dumps(body)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


MESSAGES = "value string, offset long, timestamp timestamp"


class Inbox:
    """A topic of files, and a store fed from it."""

    def __init__(self, spark, root, **how):
        self.spark, self.root, self.how = spark, root, how
        self.store = tables.SpanStore(spark, str(root / "store"))

    def send(self, *texts):
        rows = [(t, i, at(i)) for i, t in enumerate(texts)]
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def ingest(self):
        stream = self.spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in"))
        drain(start_ingest(stream, self.store, str(self.root / "check"), once=True, **self.how))


def test_ingest_stores_good_and_bad(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.send(message(0), message(1), "{nope", message(2, tokens_in=None))
    box.ingest()
    # A copy is kept: nothing is deduplicated on the way in.
    box.send(message(1), message(3))
    box.ingest()
    box.ingest()
    assert sorted(r["span_id"] for r in box.store.spans().collect()) == ["s0", "s1", "s1", "s3"]
    refused = {(r["reason"], r["value"] is None) for r in box.store.refused().collect()}
    assert refused == {("not a JSON object", False), ("tokens_in: not an integer", False)}
    assert box.store.spans(since="2026-01-02").count() == 3
    # The store's clock, not the sender's.
    assert box.store.spans().where("ingested_at < current_timestamp() - INTERVAL 1 HOUR").count() == 0
    assert len(box.store.table.version().parts) == 2


def test_a_batch_is_stored_once_and_merges_keep_rows(spark, tmp_path):
    box = Inbox(spark, tmp_path, compact_every=3)
    for k in range(4):
        box.send(*[message(10 * k + i) for i in range(4)], "{nope")
        box.ingest()
    before = box.store.table.version(2)
    after = box.store.table.version()
    # Batches 0 to 2 were merged into one part, by day; batch 3 came after.
    assert [p.rows for p in before.parts] == [5, 5, 5] and sorted(p.rows for p in after.parts) == [5, 15]
    assert sum(p.files for p in after.parts) < 4 * before.parts[0].files
    assert box.store.spans().count() == 16 and box.store.refused().count() == 4
    assert box.store.spans(version=2).count() == 12

    decoded = decode(spark.createDataFrame([(message(99), 0, at(0))], MESSAGES))
    assert box.store.append(decoded, "ingest", 3) is None  # tried again, after its commit
    assert box.store.spans().count() == 16
    assert box.store.append(decoded, "another", 3) is not None
    assert box.store.compact() and box.store.compact() == []
    assert box.store.spans().count() == 17
    assert sorted(r.span_id for r in box.store.runs("2026-01-01", "2026-01-01").collect()) == sorted(r.span_id for r in box.store.spans().collect())


def test_secrets_are_blanked_on_the_way_in(spark, tmp_path):
    box = Inbox(spark, tmp_path, redact=True)
    box.send(message(0, attributes={"password": "hunter2", "note": "plain"}))
    box.ingest()
    (row,) = box.store.spans().collect()
    assert json.loads(row.attributes) == {"password": "[REDACTED]", "note": "plain"} and row.redacted


def failing(trace_id, i, ms):
    return span(trace_id, f"s{i}", None, i, name="tool", status="error", error_message="boom", ingested_at=at(ms), seq=i)


class Watch:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.spans, self.scored, self.nodes, self.found = (str(root / d) for d in ("spans", "scored", "nodes", "found"))
        self.batches = []

    def arrive(self, *rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.spans)

    def table(self, since=None, until=None):
        return self.spark.read.schema(SPAN_SCHEMA).parquet(self.spans)

    def poll(self, node_path=None):
        stream = self.spark.readStream.schema(SPAN_SCHEMA).parquet(self.spans)
        drain(
            start_watch(
                stream, self.table, self.scored, node_path or self.nodes, self.found, str(self.root / "check"),
                on_scored=lambda s, i: self.batches.append((s.nodes.count(), runs_evaluated(s.summaries).first()[0])),
                once=True,
            )
        )

    def scored_runs(self):
        return sorted(r["trace_id"] for r in read_scored(self.spark, self.scored).collect())


def test_a_run_is_scored_once_when_it_has_settled(spark, tmp_path):
    w = Watch(spark, tmp_path)
    w.arrive(failing("demo", 0, 0), failing("demo", 1, 500))
    w.poll()
    w.arrive(*[failing("demo", i, 1000 + i) for i in range(2, 8)])
    w.poll()
    assert w.scored_runs() == [] and w.batches == []

    # Another run a minute later: demo has been quiet for long.
    w.arrive(failing("other", 0, 60_000))
    w.poll()
    assert w.scored_runs() == ["demo"] and w.batches == [(8, 1)]
    found = {r["rule"]: r["severity"] for r in spark.read.parquet(w.found).collect()}
    assert found == {"repeated_tool_failure": "critical", "runaway_loop": "warning"}
    assert tables.read_nodes(spark, w.nodes).count() == 8

    # A straggler is stored, and counted as late, but the run is not rescored.
    w.arrive(failing("demo", 9, 100_000), failing("third", 0, 200_000))
    w.poll()
    assert w.scored_runs() == ["demo", "other"] and w.batches[1:] == [(1, 1)]
    moments = read_scored(spark, w.scored).withColumn("scored_at", F.lit(at(50_000)))
    assert {r["trace_id"]: r["late_after_score"] for r in late_spans(w.table(), moments).collect()} == {"demo": 1, "other": 1}


def test_older_arrivals_in_later_batches_are_scored(spark, tmp_path):
    """No run is lost: what arrives behind the newest arrival counts like the rest."""

    w = Watch(spark, tmp_path)
    w.arrive(failing("a", 0, 0), failing("b", 0, 60_000))
    w.poll()
    assert w.scored_runs() == ["a"]
    # Run c is older than all of the batch before.
    w.arrive(*[failing("c", i, 30_000 + i) for i in range(4)])
    w.poll()
    assert w.scored_runs() == ["a", "c"]
    assert {r["trace_id"] for r in spark.read.parquet(w.found).collect()} == {"c"}
    # b goes on before it is quiet; it stays open, with d, until e is far ahead.
    w.arrive(failing("b", 1, 61_000), failing("d", 0, 62_000))
    w.poll()
    assert w.scored_runs() == ["a", "c"]
    w.arrive(failing("e", 0, 90_000))
    w.poll()
    assert w.scored_runs() == ["a", "b", "c", "d"]
    assert [n for n, _ in w.batches] == [1, 4, 3]


def test_a_retried_batch_starts_from_the_same_runs(spark, tmp_path):
    pending = Pending(spark, str(tmp_path / "pending"))
    none = spark.createDataFrame([], SCORED_SCHEMA)
    assert pending.advance(frame(spark, [failing("a", 0, 0)]), none, 0, "3 seconds").count() == 0
    for _ in range(2):
        later = pending.advance(frame(spark, [failing("b", 0, 10_000)]), none, 1, "3 seconds")
        assert [(r.trace_id, r.spans) for r in later.collect()] == [("a", 1)]
    assert pending.advance(frame(spark, [failing("a", 1, 20_000)]), none, 2, "3 seconds").select("trace_id").first()[0] == "b"


def test_existing_runs_are_ignored(spark, tmp_path):
    w = Watch(spark, tmp_path)
    w.arrive(failing("old", 0, 0))
    ignore_existing(w.table(), w.scored)
    w.arrive(failing("new", 0, 10_000), failing("last", 0, 60_000))
    w.poll()
    assert w.scored_runs() == ["new", "old"] and w.batches == [(1, 1)]


def test_a_batch_tried_again_keeps_its_marks(spark, tmp_path):
    path = str(tmp_path / "scored")
    for _ in range(2):
        mark_scored(spark.createDataFrame([("a",)], "trace_id string"), path, 3)
    mark_scored(spark.createDataFrame([("b",)], "trace_id string"), path, 4)
    assert sorted(r["trace_id"] for r in read_scored(spark, path).collect()) == ["a", "b"]


def test_failing_to_store_trees_does_not_stop_scoring(spark, tmp_path, monkeypatch):
    from spanloom.plans import scoring

    def broken(*_):
        raise OSError("disk gone")

    monkeypatch.setattr(scoring, "write_nodes", broken)
    w = Watch(spark, tmp_path)
    w.arrive(*[failing("demo", i, i) for i in range(3)], failing("other", 0, 60_000))
    w.poll()
    assert w.scored_runs() == ["demo"]
    assert spark.read.parquet(w.found).count() == 1


def test_ticks_settle_a_silent_stream(spark, tmp_path):
    """With a heartbeat the last run settles though nothing else arrives."""

    spans = str(tmp_path / "spans")
    frame(spark, [failing("demo", 0, 0)]).write.parquet(spans)
    stream = spark.readStream.schema(SPAN_SCHEMA).parquet(spans)
    settled = settled_runs(stream, heartbeat=ticks(spark))
    query = (
        settled.writeStream.format("memory").queryName("ticked").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    )
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("ticked").count():
                break
        assert [r["trace_id"] for r in spark.table("ticked").collect()] == ["demo"]
    finally:
        query.stop()


def test_repeats_can_be_dropped(spark, tmp_path):
    path = str(tmp_path / "spans")
    frame(spark, [failing("t", 0, 0), failing("t", 0, 5), failing("t", 1, 9)]).write.parquet(path)
    query = (
        without_repeats(spark.readStream.schema(SPAN_SCHEMA).parquet(path)).writeStream.format("memory")
        .queryName("once").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    drain(query)
    assert sorted(r["span_id"] for r in spark.table("once").collect()) == ["s0", "s1"]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before, parts = spark.conf.get(key, None), spark.conf.get("spark.sql.shuffle.partitions")
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_timers_settle_runs_once(spark, tmp_path, rocksdb):
    """Open runs are in the state; a timer settles each; stragglers count as late and are not scored again."""

    w = Watch(spark, tmp_path)
    check = str(tmp_path / "check")

    def start(quiet):
        stream = spark.readStream.schema(SPAN_SCHEMA).parquet(w.spans)
        return start_timed_watch(
            stream, w.table, w.nodes, w.found, check, timedelta(seconds=quiet), every="500 milliseconds",
            on_scored=lambda s, i: w.batches.append(sorted(r[0] for r in s.summaries.select("trace_id").collect())),
        )

    def until(holds):
        for _ in range(120):
            if (said := holds()) or query.exception() is not None:
                break
            time.sleep(0.5)
        assert query.exception() is None
        return said

    # Arrivals of a sender whose clock is years behind: only Spark's own clock counts.
    w.arrive(failing("demo", 0, 0), failing("demo", 1, 500), failing("other", 0, 86_400_000 * 400), span(None, "x"))
    query = start(3600)
    try:
        assert until(lambda: (query.lastProgress or {}).get("batchId", -1) >= 1)
    finally:
        query.stop()
    assert {(r.trace_id, r.spans) for r in open_runs(spark, check).collect()} == {("demo", 2), ("other", 1)}
    assert scored_runs(spark, check).count() == 0 and w.batches == []

    # After a restart the state is there; more spans of a run put its timer off, on the new quiet time.
    w.arrive(*[failing("demo", i, 1000 + i) for i in range(2, 8)], failing("third", 0, 5))
    query = start(1)
    try:
        assert until(lambda: sum(w.batches, []).count("demo") == 1 and "third" in sum(w.batches, []))
        w.arrive(failing("demo", 9, 2_000))
        assert until(lambda: scored_runs(spark, check).where("late = 1").count() == 1)
    finally:
        query.stop()
    assert {r.trace_id for r in open_runs(spark, check).collect()} == {"other"}
    assert {(r.trace_id, r.late) for r in scored_runs(spark, check).collect()} == {("demo", 1), ("third", 0)}
    assert sorted(sum(w.batches, [])) == ["demo", "third"]
    found = {(r["trace_id"], r["rule"]) for r in spark.read.parquet(w.found).collect()}
    assert ("demo", "runaway_loop") in found


def test_runs_of_a_bucket_share_calls_to_the_state(monkeypatch):
    """However many runs come and settle, the state is called a few times a bucket and its slots."""

    calls = Counter()

    class Value:
        kept = None

        def get(self):
            calls["run"] += 1
            return self.kept

        def update(self, value):
            calls["run"] += 1
            self.kept = value

        def clear(self):
            self.update(None)

    class Map(dict):
        def exists(self):
            return bool(self)

        def getValue(self, key):  # noqa: N802
            calls["mark"] += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            calls["mark"] += 1
            self[key] = value

    class Handle:
        timers = set()

        def getValueState(self, *_, **__):  # noqa: N802
            return Value()

        def getMapState(self, *_, **__):  # noqa: N802
            return Map()

        def registerTimer(self, at):  # noqa: N802
            calls["timer"] += 1
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            calls["timer"] += 1
            self.timers.remove(at)

    clock = lambda at: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: at, getExpiryTimeInMs=lambda: at)
    came = lambda runs: pd.DataFrame([(1, i % 4, f"r{i}", 50 + i, timers._NO_DAY if i % 2 else i) for i in runs], columns=["bucket", "slot", "trace_id", "last_arrival", "day"])
    settle = timers.SettleRuns(100)
    settle.init(handle := Handle())
    assert not [*settle.handleInputRows((1,), iter([came(range(3000)), came(range(10))]), clock(1000))]
    assert not [*settle.handleInputRows((1,), iter([came(range(2000))]), clock(1050))]
    assert handle.timers == {1100, 1150}
    first = pd.concat(settle.handleExpiredTimer((1,), clock(1100), clock(1100)))
    assert first["trace_id"].tolist() == [f"r{i}" for i in range(2000, 3000)] and set(first["spans"]) == {1}
    then = pd.concat(settle.handleExpiredTimer((1,), clock(1160), clock(1150)))
    assert then["spans"].tolist() == [3] * 10 + [2] * 1990
    assert [*then.iloc[7, 2:]] == [57, None, None] and [*then.iloc[8, 2:]] == [58, 8, 8]
    # Stragglers count as late and do not wait again.
    assert not [*settle.handleInputRows((1,), iter([came(range(100))]), clock(2000))] and settle.run.get() is None
    assert sum(late for _, _, lates, _ in settle.mark.values() for late in lates) == 100
    assert calls["timer"] == 2 and calls["run"] + calls["mark"] < 50


def test_spans_of_many_settled_runs_are_chosen_once(spark, monkeypatch):
    """A list of runs too long to broadcast is not repeated, and its spans are stored for all that scoring asks."""

    work = Workspace(spark, "due")
    spans = frame(spark, [span(t, f"{t}{i}") for t in ("a", "b", "c") for i in range(3)] + [span(None, "x")])
    due = work.keep(spark.createDataFrame([("a",), ("c",), ("gone",)], "trace_id string"), "due")
    rows = lambda found: sorted((r.trace_id, r.span_id) for r in found.collect())
    few = timers._spans_of(due, spans, work)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    many = timers._spans_of(due, spans, work)
    assert rows(few) == rows(many) == [(t, f"{t}{i}") for t in "ac" for i in range(3)]
    assert len(many.inputFiles()) >= 1 and all(work.root in f for f in many.inputFiles())
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_marks_may_expire(spark, tmp_path, rocksdb):
    """With an expiry a run that comes back much later is scored once more."""

    w = Watch(spark, tmp_path)
    w.arrive(failing("demo", 0, 0))
    settled = settled_by_timer(spark.readStream.schema(SPAN_SCHEMA).parquet(w.spans), timedelta(seconds=1), timedelta(seconds=2))
    query = (
        settled.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "check"))
        .trigger(processingTime="500 milliseconds").start()
    )
    try:
        for count in (1, 2):
            for _ in range(80):
                if spark.table("expiring").count() >= count:
                    break
                time.sleep(0.5)
            if count == 1:
                time.sleep(4)
                w.arrive(failing("demo", 1, 9))
        assert [(r.trace_id, r.spans, str(r.first_day)) for r in spark.table("expiring").collect()] == [("demo", 1, "2025-03-14")] * 2
    finally:
        query.stop()


def test_waiting_for_timers_needs_no_pause_between_batches(spark, monkeypatch):
    """All runs are scored while batches follow each other without a pause."""

    class Busy:
        name, status = "busy", {"isTriggerActive": True}
        polls = 0

        @property
        def lastProgress(self):  # noqa: N802
            return {"batchId": self.polls} if self.polls else None

        def awaitTermination(self, seconds):  # noqa: N802
            self.polls += 1
            assert self.polls < 10
            return False

    query = Busy()
    monkeypatch.setattr(timers, "scored_runs", lambda *_: spark.range(query.polls - 1))
    timers.wait_until_scored(query, spark, "none", 4, batches=3)
    assert query.polls == 5


def test_a_batch_takes_files_as_its_rows_ask(spark, tmp_path, monkeypatch):
    """Batches of many rows are written and read as several files, no task having them all."""

    monkeypatch.setattr(queries, "_FILE_ROWS", 100)
    rows = spark.range(0, 2000, 1, 4)
    files = queries._files_a_batch(rows, 4)
    assert files == 5 and queries._files_a_batch(rows.limit(0), 4) == 1
    for k in range(4):
        queries._land(rows.where(F.col("id") % 4 == k), files, str(tmp_path / "topic"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "topic"))
    seen = []
    drain(
        stream.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.count("*"), F.min(F.col("id") % 4), F.max(F.col("id") % 4)).first()))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert [tuple(r) for r in seen] == [(500, k, k) for k in range(4)]
