"""Run summaries, detection and metrics on small runs with known outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from spans import FAIL_COST, FAILS, LOOPS, at, frame, misbehaving_run, span
from spanloom import Thresholds
from spanloom.operators import detect, metrics
from spanloom.operators.summary import last_starts, recent_runs, run_summaries
from spanloom.plans.scoring import score


def one(df):
    (row,) = df.collect()
    return row


def test_rollup(spark):
    rows = [
        span("t", "a", None, 0, duration_ms=100.0, cost_usd=0.01, tokens_in=100, tokens_out=50, end_time=at(100)),
        span("t", "b", "a", 100, cost_usd=0.02, tokens_in=200, tokens_out=80, end_time=at(300), agent_name="x"),
        span("t", "c", "a", 300, duration_ms=50.0, cost_usd=0.005, tokens_in=10, tokens_out=5, end_time=at(350), status="error", agent_name=""),
    ]
    s = one(run_summaries(frame(spark, rows)))
    assert float(s["total_cost_usd"]) == 0.035
    assert (s["total_tokens_in"], s["total_tokens_out"], s["total_tokens"]) == (310, 135, 445)
    assert (s["sum_step_ms"], s["wall_clock_ms"]) == (350.0, 350.0)
    assert (s["step_count"], s["error_count"], s["agent_count"]) == (3, 1, 2)


def test_parallel_steps_and_missing_bounds(spark):
    rows = [
        span("par", "a", None, 0, end_time=at(100)), span("par", "b", None, 0, end_time=at(100)),
        span("open", "a", None, 0), span("open", "b", None, 40),
        span("none", "a", None, None, end_time=at(5)),
        span("back", "a", None, 50, end_time=at(10)),
    ]
    got = {r["trace_id"]: r for r in run_summaries(frame(spark, rows)).collect()}
    assert (got["par"]["sum_step_ms"], got["par"]["wall_clock_ms"]) == (200.0, 100.0)
    assert got["open"]["wall_clock_ms"] == 40.0 and got["open"]["end_time"] == at(40)
    assert got["none"]["wall_clock_ms"] == 0.0 and got["none"]["end_time"] is None
    assert got["back"]["wall_clock_ms"] == 0.0


def test_copies_and_spans_without_id_count_in_totals_only(spark):
    rows = [span("t", "a", cost_usd=0.6, seq=0), span("t", "a", cost_usd=0.5, seq=1), span("t", None, cost_usd=0.1, seq=2)]
    s = score(frame(spark, rows))
    assert one(s.summaries)["step_count"] == 3
    assert s.nodes.count() == 1
    found = one(s.findings)
    assert found["rule"] == detect.COST and found["summary"] == "run cost $1.2000 exceeded limit $1.0000"
    assert [r["cost_usd"] for r in detect.evidence_spans(s.nodes, s.findings).collect()] == [0.5]


@pytest.fixture(scope="module")
def graded(spark):
    """Runs named after what they hold: loops, failures, costs at each boundary."""

    rows = []
    for n in (4, 5, 6, 9, 10):
        rows += [span(f"loop{n}", f"s{i}", None, i, step_type="llm_call") for i in range(n)]
    for n in (2, 3, 5, 6):
        rows += [span(f"fail{n}", f"s{i}", None, i, status="error", error_message="boom", name="f", step_type="tool_call") for i in range(n)]
    rows += [span("llmfail", f"s{i}", None, i, status="error", step_type="llm_call", name=f"n{i // 2}") for i in range(4)]
    for cost in ("1.00", "1.0001", "2.00", "2.50"):
        rows.append(span(f"cost{cost}", "s", cost_usd=float(cost)))
    rows += [span("unnamed", f"s{i}", None, i, name=None, agent_name=None, step_type=None) for i in range(5)]
    return score(frame(spark, rows))


def test_thresholds_at_their_boundaries(graded):
    got = {(r["trace_id"], r["rule"]): r["severity"] for r in graded.findings.collect()}
    assert got == {
        ("loop5", detect.LOOP): "warning",
        ("loop6", detect.LOOP): "warning",
        ("loop9", detect.LOOP): "warning",
        ("loop10", detect.LOOP): "critical",
        ("fail3", detect.FAILURE): "warning",
        ("fail5", detect.FAILURE): "warning",
        ("fail5", detect.LOOP): "warning",
        ("fail6", detect.FAILURE): "critical",
        ("fail6", detect.LOOP): "warning",
        ("cost1.0001", detect.COST): "warning",
        ("cost2.00", detect.COST): "warning",
        ("cost2.50", detect.COST): "critical",
        ("unnamed", detect.LOOP): "warning",
    }


def test_evidence_matches_missing_names(graded):
    spans = detect.evidence_spans(graded.nodes, graded.findings)
    assert spans.where("trace_id = 'unnamed'").count() == 5


def test_thresholds_are_settable(spark):
    s = score(frame(spark, [span("t", f"s{i}", None, i) for i in range(4)]), Thresholds(loop_count=4))
    assert one(s.findings)["summary"] == "agent repeated 'step' (tool_call) 4x (threshold 4)"


def test_misbehaving_run(spark):
    s = score(frame(spark, misbehaving_run()))
    rows = s.findings.orderBy("rule_no", "first_visit").collect()
    assert [(r["rule"], r["severity"], r["count"]) for r in rows] == [
        # The failing tool is visited first: last siblings come first.
        (detect.LOOP, "warning", FAILS),
        (detect.LOOP, "critical", LOOPS),
        (detect.FAILURE, "critical", FAILS),
        (detect.COST, "critical", None),
    ]
    docs = {
        (r["rule"], r["count"]): r
        for r in detect.finding_documents(s.nodes, s.findings).collect()
    }
    failure = docs[detect.FAILURE, FAILS]
    backwards = range(FAILS - 1, -1, -1)
    assert failure["span_ids"] == [f"send{i}" for i in backwards]
    evidence = json.loads(failure["evidence"])
    assert evidence["tool"] == "parcel.send" and evidence["error_messages"] == [f"depot {i} closed" for i in backwards]
    cost = docs[detect.COST, None]
    # Equally dear spans come in visit order.
    assert cost["span_ids"] == [f"send{i}" for i in backwards][:3]
    assert json.loads(cost["evidence"])["top_spans"][0] == {"span_id": f"send{FAILS - 1}", "cost_usd": FAIL_COST}


def test_large_findings_come_in_parts_that_are_whole(spark):
    s = score(frame(spark, misbehaving_run()))
    whole = detect.finding_documents(s.nodes, s.findings)
    parts = detect.finding_documents(s.nodes, s.findings, part=4)
    assert parts.where(F.size("span_ids") > 4).count() == 0
    joined, numbers = {}, {}
    for r in parts.orderBy("part").collect():
        joined.setdefault((r["rule"], r["first_visit"]), []).extend(r["span_ids"])
        numbers.setdefault((r["rule"], r["first_visit"]), []).append(r["part"])
    # The looping lookups are visited late, and still start with part 0.
    assert all(n == list(range(len(n))) for n in numbers.values())
    assert joined == {(r["rule"], r["first_visit"]): r["span_ids"] for r in whole.collect()}


def test_a_rule_can_be_added(spark):
    def slow(nodes, summaries, limits):
        late = summaries.where("wall_clock_ms > 10").withColumn("first_visit", F.lit(0).cast("long"))
        return detect._finding(late, "slow_run", F.lit("warning"), F.lit("slow"), 10)

    def first_spans(found, nodes):
        return detect._spans_of(found, nodes.where("visit_index < 2"), ())

    def shown(errors, tops):
        return F.to_json(F.struct(F.col("threshold").alias("limit_ms"), tops["span_id"].alias("spans")))

    for particulars, key in ((shown, "limit_ms"), (None, "threshold")):
        rules = (*detect.RULES, detect.Rule("slow_run", slow, first_spans, particulars))
        s = score(frame(spark, misbehaving_run()), rules=rules)
        assert s.findings.agg(F.max("rule_no")).first()[0] == 4
        document = one(detect.finding_documents(s.nodes, s.findings, rules).where("rule = 'slow_run'"))
        assert json.loads(document["evidence"])[key] == 10 and len(document["span_ids"]) == 2
        counts = {(r["rule"], r["severity"]): r["findings"] for r in metrics.findings_by_severity(s.findings).collect()}
        assert counts["slow_run", "warning"] == 1 and len(counts) == 7
        assert metrics.findings_by_severity(s.findings, rules).count() == 8


def test_odd_costs_are_reported_not_fatal(spark):
    odd = [1.5, None, float("nan"), float("inf"), 1e11, 1e40]
    summary = one(run_summaries(frame(spark, [span("t", f"s{i}", None, i, cost_usd=c) for i, c in enumerate(odd)])))
    assert float(summary["total_cost_usd"]) == 1e11 + 1.5 and summary["unusable_costs"] == 3


def test_findings_of_undated_runs_are_counted(spark):
    rows = [span("dated", f"s{i}", None, i) for i in range(6)] + [span("undated", f"s{i}", None, None) for i in range(6)]
    spans = frame(spark, rows)
    over = metrics.findings_over_time(score(spans).findings, last_starts(spans)).orderBy("interval_start").collect()
    assert [(r["interval_start"] is None, r["findings"], r["findings_total"]) for r in over] == [(True, 1, 1), (False, 1, 2)]


def test_metrics(spark):
    rows = [span("old", "a", None, -1000, cost_usd=0.03)] + [span("new", f"s{i}", None, i, cost_usd=2.0) for i in range(6)]
    spans = frame(spark, rows)
    s = score(spans)
    g = one(metrics.last_run_gauges(s.summaries, s.findings, last_starts(spans)))
    assert (g["last_run_cost_usd"], g["last_run_loops"], g["last_run_tool_failures"]) == (12.0, 6, 0)
    counts = {(r["rule"], r["severity"]): r["findings"] for r in metrics.findings_by_severity(s.findings).collect()}
    assert len(counts) == 6 and counts[detect.LOOP, "warning"] == 1 and counts[detect.COST, "critical"] == 1
    assert counts[detect.FAILURE, "critical"] == 0
    buckets = {r["le"]: r["runs"] for r in metrics.cost_histogram(s.summaries).collect()}
    assert buckets["0.01"] == 0 and buckets["0.05"] == 1 and buckets["10.0"] == 1 and buckets["+Inf"] == 2
    lights = one(metrics.alarm_levels(metrics.critical_findings(s.findings), metrics.last_run_gauges(s.summaries, s.findings, last_starts(spans))))
    assert tuple(lights) == ("red", "red", "orange", "green")


def test_recent_runs_come_oldest_first(spark):
    spans = frame(spark, [span(t, "a", None, ms) for t, ms in (("x", 3), ("y", 1), ("z", 2))])
    assert [r["trace_id"] for r in recent_runs(spans, 2).collect()] == ["z", "x"]
