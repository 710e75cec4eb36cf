"""Counters folded batch by batch against one pass over all runs."""

import threading

import pytest

from spans import frame, misbehaving_run, span
from spanloom.operators import metrics
from spanloom.operators.summary import last_starts
from spanloom.plans.scoring import score
from spanloom.streaming.counters import Counters, added_by, merged

DAY = 86_400_000


def shown(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def panels(kept):
    return [
        shown(x) for x in (
            kept.findings_by_severity(), kept.findings_over_time(), kept.critical_findings(), kept.runs_evaluated(),
            kept.cost_histogram(), kept.last_run_gauges(),
        )
    ]


def whole(spark, rows):
    spans = frame(spark, rows)
    scored, starts = score(spans), last_starts(spans)
    return [
        shown(x) for x in (
            metrics.findings_by_severity(scored.findings), metrics.findings_over_time(scored.findings, starts),
            metrics.critical_findings(scored.findings), metrics.runs_evaluated(scored.summaries),
            metrics.cost_histogram(scored.summaries), metrics.last_run_gauges(scored.summaries, scored.findings, starts),
        )
    ]


def run(trace_id, day, cost):
    return [span(trace_id, "only", ms=None if day is None else day * DAY, cost_usd=cost)]


def bad(trace_id, day):
    return [{**r, "start_time": span("", "", ms=day * DAY)["start_time"]} for r in misbehaving_run(trace_id)]


# Ties of the newest start, a bound met exactly, a run beyond all bounds, undated runs, two days.
BATCHES = (
    run("a", 0, 0.01) + bad("bad1", 1) + run("b", 3, 0.05),
    run("c", None, 12.5) + [{**r, "start_time": None} for r in misbehaving_run("undated")],
    bad("bad2", 3) + bad("bad3", 1) + run("z", 2, 0.0),
)


def fold(spark, kept, rows, batch, stream="watch"):
    spans = frame(spark, rows)
    return kept.fold(score(spans), last_starts(spans), stream, batch)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_folds_equal_one_pass(spark, tmp_path, order):
    kept = Counters(spark, str(tmp_path / "counters"))
    for batch, k in enumerate(order):
        assert fold(spark, kept, BATCHES[k], batch) == batch
    want = whole(spark, [r for rows in BATCHES for r in rows])
    assert panels(kept) == want
    assert want[-1][0][0] == "bad2"  # of the runs with the newest start the greatest id
    # Tried again: nothing is added, also not by an earlier batch.
    for batch in (2, 0):
        assert fold(spark, kept, BATCHES[0], batch) is None
    assert panels(kept) == want
    assert len(kept.table.version().parts) == 1


def test_nothing_kept_yet(spark, tmp_path):
    kept = Counters(spark, str(tmp_path / "counters"))
    assert panels(kept) == whole(spark, []) or kept.read().count() == 0
    assert kept.runs_evaluated().first()[0] == 0 and kept.critical_findings().first()[0] == 0
    assert {r.findings for r in kept.findings_by_severity().collect()} == {0}
    # A batch without runs is remembered, and the next one counts.
    assert fold(spark, kept, [], 0) == 0 and fold(spark, kept, [], 0) is None
    assert fold(spark, kept, BATCHES[0], 1) == 1
    assert panels(kept) == whole(spark, BATCHES[0])


def test_two_writers_lose_nothing(spark, tmp_path):
    kept = Counters(spark, str(tmp_path / "counters"))
    made = []
    writers = [
        threading.Thread(target=lambda k=k: made.append(fold(spark, kept, BATCHES[k], 0, f"stream{k}"))) for k in range(3)
    ]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(made) == [0, 1, 2]
    assert panels(kept) == whole(spark, [r for rows in BATCHES for r in rows])


def test_merging_is_associative(spark):
    parts = []
    for rows in BATCHES:
        spans = frame(spark, rows)
        parts.append(added_by(score(spans), last_starts(spans)))
    a, b, c = parts
    left = merged(merged(a.unionByName(b)).unionByName(c))
    right = merged(a.unionByName(merged(b.unionByName(c))))
    assert shown(left) == shown(right) and left.schema == a.schema
