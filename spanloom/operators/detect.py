"""Detection rules: runaway loops, repeated tool failures, cost spikes.

Rules read deduplicated tree nodes and run summaries and yield *findings*, one
row each. A finding's evidence spans are a table of their own, one row per
span: a loop may have more repetitions than fit one array. ``finding_documents``
brings both together in the shape of one document per finding, in parts where
a finding has more than ``PART`` spans.

``first_visit`` is the visit index of a finding's first span. It orders the
findings of one rule and, with run and rule, identifies a finding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.config import Thresholds
from spanloom.functions import text
from spanloom.schema import COST_DECIMAL

# Rule names in reporting order, and severities.
LOOP, FAILURE, COST = "runaway_loop", "repeated_tool_failure", "cost_spike"
RULE_NAMES = (LOOP, FAILURE, COST)
WARNING, CRITICAL = "warning", "critical"
SEVERITIES = (WARNING, CRITICAL)
TOP_SPANS = 3

# Columns detection needs nodes to carry.
DETECT_CARRY = ("agent_name", "step_type", "name", "status", "error_message", "cost_usd")

# Longest array of evidence spans in one document row.
PART = 10_000

_FINDING_COLUMNS = (
    "trace_id",
    "rule_no",
    "rule",
    "severity",
    "summary",
    "first_visit",
    "agent_name",
    "step_type",
    "name",
    "count",
    "threshold",
    "total_cost_usd",
)
_FINDING_KEY = ("trace_id", "rule", "first_visit")


@dataclass(frozen=True)
class Rule:
    """A rule: how to find, and which spans are the evidence of its findings.

    ``particulars`` makes the evidence of a document as JSON from the finding's
    columns, the spans' error messages and (span_id, cost_usd) pairs; without
    it the document shows the finding's signature, count, threshold and errors.
    """

    name: str
    find: Callable[[DataFrame, DataFrame, Thresholds], DataFrame]
    evidence: Callable[[DataFrame, DataFrame], DataFrame]
    particulars: Callable[[Column, Column], Column] | None = None


def severity(is_critical: Column) -> Column:
    return F.when(is_critical, F.lit(CRITICAL)).otherwise(F.lit(WARNING))


def runaway_loops(nodes: DataFrame, summaries: DataFrame, limits: Thresholds) -> DataFrame:
    """One signature (agent, step type, name) repeated too often, whatever its status."""

    groups = _repeats(nodes, ("agent_name", "step_type", "name"), limits.loop_count)
    return _finding(
        groups,
        LOOP,
        severity(F.col("count") >= 2 * limits.loop_count),
        text.loop_sentence(
            F.col("agent_name"), F.col("step_type"), F.col("name"), F.col("count"), limits.loop_count
        ),
        limits.loop_count,
    )


def tool_failures(nodes: DataFrame, summaries: DataFrame, limits: Thresholds) -> DataFrame:
    """One tool of one agent failing too often."""

    groups = _repeats(failed_tool_calls(nodes), ("agent_name", "name"), limits.failure_count)
    return _finding(
        groups,
        FAILURE,
        severity(F.col("count") >= 2 * limits.failure_count),
        text.failure_sentence(F.col("agent_name"), F.col("name"), F.col("count"), limits.failure_count),
        limits.failure_count,
    )


def cost_spikes(nodes: DataFrame, summaries: DataFrame, limits: Thresholds) -> DataFrame:
    """A run that cost strictly more than the limit, copies of spans included."""

    limit = F.lit(limits.cost_limit_usd).cast(COST_DECIMAL)
    over = summaries.where(F.col("total_cost_usd") > limit).withColumn(
        "first_visit", F.lit(0).cast("long")
    )
    return _finding(
        over,
        COST,
        severity(F.col("total_cost_usd") > 2 * limit),
        text.cost_sentence(F.col("total_cost_usd"), limits.cost_limit_usd),
        limits.cost_limit_usd,
    )


def failed_tool_calls(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("step_type") == "tool_call") & (F.col("status") == "error"))


def top_spans(nodes: DataFrame, k: int = TOP_SPANS) -> DataFrame:
    """Each run's ``k`` priciest spans, free ones left out.

    Spark cuts each run to ``k`` rows per task before the shuffle.
    """

    rank = F.row_number().over(
        Window.partitionBy("trace_id").orderBy(F.col("cost_usd").desc(), F.col("visit_index"))
    )
    return (
        nodes.where("cost_usd > 0").withColumn("cost_rank", rank).where(F.col("cost_rank") <= k)
    )


def _repeats(nodes: DataFrame, signature: tuple[str, ...], at_least: int) -> DataFrame:
    return (
        nodes.groupBy("trace_id", *signature)
        .agg(F.count("*").alias("count"), F.min("visit_index").alias("first_visit"))
        .where(F.col("count") >= at_least)
    )


def _finding(found: DataFrame, rule: str, level: Column, sentence: Column, threshold) -> DataFrame:
    have = set(found.columns)
    optional = {
        "agent_name": "string",
        "step_type": "string",
        "name": "string",
        "count": "long",
        "total_cost_usd": "decimal(38,8)",
    }
    cells = {
        "trace_id": F.col("trace_id"),
        "rule_no": F.lit(RULE_NAMES.index(rule) + 1 if rule in RULE_NAMES else len(RULE_NAMES) + 1),
        "rule": F.lit(rule),
        "severity": level,
        "summary": sentence,
        "first_visit": F.col("first_visit"),
        "threshold": F.lit(float(threshold)),
        **{
            c: (F.col(c) if c in have else F.lit(None)).cast(t)
            for c, t in optional.items()
        },
    }
    return found.select(*[cells[c].alias(c) for c in _FINDING_COLUMNS])


_EVIDENCE = ("visit_index", "span_id", "error_message", "cost_usd")


def _spans_of(found: DataFrame, nodes: DataFrame, signature: tuple[str, ...]) -> DataFrame:
    """Spans with a finding's signature; missing names match missing names.

    Findings are one row per signature. Where they are few Spark broadcasts
    them at run time; where one signature holds very many spans, adaptive skew
    handling splits it.
    """

    n, f = nodes.alias("n"), found.alias("f")
    match = F.col("n.trace_id") == F.col("f.trace_id")
    for c in signature:
        match = match & F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}"))
    return n.join(f, match).select(
        *[F.col(f"f.{c}") for c in (*_FINDING_KEY, "count")], *[F.col(f"n.{c}") for c in _EVIDENCE]
    )


def _loop_evidence(found, nodes):
    return _spans_of(found, nodes, ("agent_name", "step_type", "name"))


def _failure_evidence(found, nodes):
    return _spans_of(found, failed_tool_calls(nodes), ("agent_name", "name"))


def _cost_evidence(found, nodes):
    """The priciest spans; their rank stands in for the visit order."""

    top = top_spans(nodes).withColumn("visit_index", F.col("cost_rank").cast("long") - 1)
    return found.select(*_FINDING_KEY, "count").join(top.select("trace_id", *_EVIDENCE), "trace_id")


_SHOW_NULLS = {"ignoreNullFields": "false"}


def _loop_json(errors: Column, tops: Column) -> Column:
    threshold = F.col("threshold").cast("int").alias("threshold")
    return F.to_json(F.struct("agent_name", "step_type", "name", "count", threshold), _SHOW_NULLS)


def _failure_json(errors: Column, tops: Column) -> Column:
    threshold = F.col("threshold").cast("int").alias("threshold")
    tool = F.col("name").alias("tool")
    return F.to_json(F.struct("agent_name", tool, "count", threshold, errors.alias("error_messages")), _SHOW_NULLS)


def _cost_json(errors: Column, tops: Column) -> Column:
    total = F.col("total_cost_usd").cast("double").alias("total_cost_usd")
    return F.to_json(F.struct(total, F.col("threshold").alias("limit_usd"), tops.alias("top_spans")))


def _plain_json(errors: Column, tops: Column) -> Column:
    cells = ("agent_name", "step_type", "name", "count", "threshold")
    return F.to_json(F.struct(*cells, errors.alias("error_messages")))


RULES: tuple[Rule, ...] = (
    Rule(LOOP, runaway_loops, _loop_evidence, _loop_json),
    Rule(FAILURE, tool_failures, _failure_evidence, _failure_json),
    Rule(COST, cost_spikes, _cost_evidence, _cost_json),
)


def find_problems(
    nodes: DataFrame,
    summaries: DataFrame,
    limits: Thresholds = Thresholds(),
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """All findings of all runs; a clean run has no rows.

    Order by ``rule_no, first_visit`` within a run for reporting order.
    """

    frames = [
        rule.find(nodes, summaries, limits).withColumn("rule_no", F.lit(i))
        for i, rule in enumerate(rules, 1)
    ]
    found = frames[0]
    for more in frames[1:]:
        found = found.unionByName(more)
    return found


def evidence_spans(nodes: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The spans behind each finding, one row each, ordered by ``visit_index``."""

    return _sized_evidence(nodes, findings, rules).drop("count")


def _sized_evidence(nodes: DataFrame, findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Evidence spans with the span count of their finding."""

    frames = [rule.evidence(findings.where(F.col("rule") == rule.name), nodes) for rule in rules]
    spans = frames[0]
    for more in frames[1:]:
        spans = spans.unionByName(more)
    return spans


def evidence_json(errors: Column, tops: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A finding's particulars as JSON, shaped by its rule."""

    shaped = _plain_json(errors, tops)
    for rule in rules:
        if rule.particulars is not None:
            shaped = F.when(F.col("rule") == rule.name, rule.particulars(errors, tops)).otherwise(shaped)
    return shaped


def finding_documents(nodes: DataFrame, findings: DataFrame, rules=RULES, part: int = PART) -> DataFrame:
    """Findings with their span ids and evidence gathered.

    Visit indexes are distinct within a run, so ``part`` consecutive ones bound
    every array. A finding of at most ``part`` spans is one row (part 0); the
    rows of a larger one are numbered 0, 1, … in visit order.
    """

    # Which part a span goes to depends on its finding's size.
    placed = _sized_evidence(nodes, findings, rules).withColumn(
        "part",
        F.when(F.coalesce("count", F.lit(0)) <= part, F.lit(0).cast("long")).otherwise(
            F.floor(F.col("visit_index") / part)
        ),
    )
    item = F.struct("visit_index", "span_id", "error_message", "cost_usd")
    gathered = placed.groupBy(*_FINDING_KEY, "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    # Stretches without a span of the finding leave no gap in the numbers.
    nth = F.row_number().over(Window.partitionBy(*_FINDING_KEY).orderBy("part")) - 1
    gathered = gathered.withColumn("part", nth.cast("long"))
    documents = findings.join(gathered, list(_FINDING_KEY), "left")
    items = F.coalesce("items", F.array().cast("array<struct<visit_index:bigint,span_id:string,error_message:string,cost_usd:double>>"))
    tops = F.transform(items, lambda s: F.struct(s["span_id"].alias("span_id"), s["cost_usd"].alias("cost_usd")))
    return documents.select(
        *_FINDING_COLUMNS,
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        F.transform(items, lambda s: s["span_id"]).alias("span_ids"),
        evidence_json(F.transform(items, lambda s: s["error_message"]), tops, rules).alias("evidence"),
    )
