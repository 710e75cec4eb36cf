"""Every operator as a query over the driver's tables.

Instants are shown as UTC text and nested values as joined text, so that
results compare value by value with another engine's.
"""

from __future__ import annotations

import functools
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions import redact, timing
from spanloom.functions.cost import base_model
from spanloom.operators import detect, metrics, protocols, reports
from spanloom.operators.assemble import assemble
from spanloom.operators.dedupe import last_written_spans, latest_nodes
from spanloom.operators.recursive import walked
from spanloom.operators.summary import last_starts, orphan_ids, recent_runs, run_summaries
from spanloom.plans.scoring import score
from spanloom.schema import COST_DECIMAL, NODE_PAYLOAD
from spanloom.session import Workspace
from spanloom.sources import exports, messages, tables
from spanloom.sources.tables import read_nodes, write_nodes
from spanloom.sources.views import conversation_spans, event_spans, order_spans
from spanloom.streaming.counters import Counters
from spanloom.streaming.ingest import start_ingest, without_repeats
from spanloom.streaming.timers import start_timed_watch, wait_until_scored
from spanloom.streaming.watch import ignore_existing, late_spans, read_scored, settled_runs, start_watch, unscored

_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DETECT = detect.DETECT_CARRY
_POSITION = ("trace_id", "span_id", "parent_span_id", "order_index", "visit_index", "depth", "orphaned", "promoted")


def _when(column: str) -> Column:
    return F.date_format(column, _TEXT).alias(column)


def _double(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def _show_times(df: DataFrame) -> DataFrame:
    return df.select(*[_when(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


# --- spans and summaries ---------------------------------------------------
def span_view(spark, sf):
    return _show_times(event_spans(spark, sf))


def run_summary(spark, sf):
    return _summary(run_summaries(event_spans(spark, sf)))


def run_summary_orders(spark, sf):
    return _summary(run_summaries(order_spans(spark, sf)))


def _summary(df):
    return _show_times(df).drop("unusable_costs").withColumns(
        {"total_cost_usd": F.col("total_cost_usd").cast("double"), "sum_step_ms": F.round("sum_step_ms", 4)}
    )


def span_last_copy(spark, sf):
    return last_written_spans(order_spans(spark, sf)).select(
        "trace_id", "span_id", _when("start_time"), "name", "status", "duration_ms", "cost_usd"
    )


def contract_violations(spark, sf):
    checked = messages.contract_check(event_spans(spark, sf))
    return (
        checked.select(F.explode("violations").alias("violation"))
        .groupBy("violation")
        .agg(F.count("*").alias("spans"))
    )


# --- trees -----------------------------------------------------------------
def tree_nodes(spark, sf):
    return assemble(event_spans(spark, sf), carry=()).select(*_POSITION)


def tree_nodes_orders(spark, sf):
    return assemble(order_spans(spark, sf), carry=()).select(*_POSITION)


def walked_places(spark, sf):
    """Depth, root and path length by a recursive query: what a root or an orphan leads to."""

    found = walked(event_spans(spark, sf))
    return found.select("trace_id", "span_id", "depth", "root_id", F.size("path").alias("steps"))


def orphans_anti_join(spark, sf):
    spans = event_spans(spark, sf).where("span_id IS NOT NULL")
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    children = spans.where("parent_span_id IS NOT NULL")
    return children.join(ids, ["trace_id", "parent_span_id"], "left_anti").select(
        "trace_id", "span_id", "parent_span_id"
    )


def orphan_list(spark, sf):
    return orphan_ids(assemble(event_spans(spark, sf), carry=())).select("trace_id", "span_id", "order_index")


def node_table_rows(spark, sf):
    rows = tables.node_rows(assemble(event_spans(spark, sf)))
    return rows.drop("written_at")


def _stored_trees(spark, sf) -> DataFrame:
    """Assembled nodes, stored for queries that read them more than once."""

    work = Workspace(spark, "trees")
    return work.keep(assemble(event_spans(spark, sf), work=work), "nodes")


def _two_versions(spark, sf):
    """The node table after each run was stored twice, the second time later."""

    nodes = _stored_trees(spark, sf)
    old = nodes.withColumns({"status": F.lit("stale"), "order_index": F.col("order_index") + 1})
    first = tables.node_rows(old, "2024-02-01 00:00:00")
    return first.unionByName(tables.node_rows(nodes, "2024-02-02 00:00:00"))


def node_latest_version(spark, sf):
    return latest_nodes(_two_versions(spark, sf)).groupBy("status", "depth").agg(
        F.count("*").alias("nodes"), F.sum("order_index").alias("order_sum")
    )


# --- detection -------------------------------------------------------------
def _found(spark, sf, view=event_spans):
    return score(view(spark, sf), carry=DETECT)


def _plain_findings(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id", "rule_no", "rule", "severity", "summary", "first_visit", "count", "threshold", _double("total_cost_usd")
    )


def runaway_loops(spark, sf):
    s = _found(spark, sf)
    return _plain_findings(s.findings.where(F.col("rule") == detect.LOOP))


def tool_failures(spark, sf):
    s = _found(spark, sf)
    return _plain_findings(s.findings.where(F.col("rule") == detect.FAILURE))


def cost_spikes(spark, sf):
    s = _found(spark, sf)
    return _plain_findings(s.findings.where(F.col("rule") == detect.COST))


def findings(spark, sf):
    return _plain_findings(_found(spark, sf).findings)


def findings_orders(spark, sf):
    return _plain_findings(_found(spark, sf, order_spans).findings)


def added_rule(spark, sf):
    """Findings of a rule that a caller brings, beside the ones that are there."""

    def find(nodes, summaries, limits):
        errors = nodes.where("status = 'error'").groupBy("trace_id").agg(F.count("*").alias("count"), F.min("visit_index").alias("first_visit"))
        none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
        return errors.where("count > 3").withColumns(
            {
                "rule": F.lit("many_errors"),
                "severity": detect.severity(F.col("count") > 4),
                "summary": F.concat(F.col("count").cast("string"), F.lit(" steps failed")),
                "threshold": F.lit(3.0),
                "total_cost_usd": F.lit(None).cast(COST_DECIMAL),
                **none("string", "agent_name", "step_type", "name"),
            }
        ).select("trace_id", "rule", "severity", "summary", "first_visit", "agent_name", "step_type", "name", "count", "threshold", "total_cost_usd")

    def evidence(findings, nodes):
        return nodes.where("status = 'error'").join(findings.select("trace_id", "rule", "first_visit", "count"), "trace_id")

    rules = (*detect.RULES, detect.Rule("many_errors", find, evidence))
    found = score(event_spans(spark, sf), carry=DETECT, rules=rules)
    return found.findings.select("trace_id", "rule_no", "rule", "severity", "first_visit", F.col("count").cast("long").alias("count"))


def failed_tool_calls(spark, sf):
    return detect.failed_tool_calls(event_spans(spark, sf)).select("trace_id", "span_id", "agent_name", "name", "error_message")


def top_spans(spark, sf):
    nodes = assemble(event_spans(spark, sf), carry=("cost_usd",))
    return detect.top_spans(nodes).select("trace_id", "cost_rank", "span_id", "cost_usd")


def evidence_spans(spark, sf):
    s = _found(spark, sf)
    return detect.evidence_spans(s.nodes, s.findings)


def finding_documents(spark, sf):
    s = _found(spark, sf)
    return detect.finding_documents(s.nodes, s.findings).select(
        "trace_id",
        "rule",
        "severity",
        "first_visit",
        "part",
        F.array_join("span_ids", ",").alias("span_ids"),
        F.get_json_object("evidence", "$.count").cast("long").alias("evidence_count"),
        F.get_json_object("evidence", "$.tool").alias("evidence_tool"),
        F.get_json_object("evidence", "$.error_messages[0]").alias("first_error"),
        F.get_json_object("evidence", "$.top_spans[0].span_id").alias("priciest"),
    )


def finding_json(spark, sf):
    s = _found(spark, sf)
    docs = exports.finding_json(detect.finding_documents(s.nodes, s.findings))
    return docs.select(
        "trace_id",
        F.get_json_object("document", "$.rule").alias("rule"),
        F.get_json_object("document", "$.severity").alias("severity"),
        F.get_json_object("document", "$.summary").alias("summary"),
        F.get_json_object("document", "$.span_ids[0]").alias("first_span"),
    )


def finding_lines(spark, sf):
    s = _found(spark, sf)
    return reports.finding_lines(detect.finding_documents(s.nodes, s.findings), s.summaries)


def one_shot_score(spark, sf):
    """Findings of the newest run only."""

    spans = event_spans(spark, sf)
    newest = recent_runs(spans, 1).select("trace_id")
    s = score(spans.join(F.broadcast(newest), "trace_id", "left_semi"), carry=DETECT)
    return _plain_findings(s.findings)


# --- metrics ---------------------------------------------------------------
def findings_by_severity(spark, sf):
    return metrics.findings_by_severity(_found(spark, sf).findings)


def critical_findings(spark, sf):
    return metrics.critical_findings(_found(spark, sf).findings)


def findings_over_time(spark, sf):
    spans = event_spans(spark, sf)
    s = score(spans, carry=DETECT)
    return _show_times(metrics.findings_over_time(s.findings, last_starts(spans)))


def runs_evaluated(spark, sf):
    return metrics.runs_evaluated(run_summaries(event_spans(spark, sf)))


def cost_histogram(spark, sf):
    return metrics.cost_histogram(run_summaries(event_spans(spark, sf))).withColumn("cost_sum", F.round("cost_sum", 6))


def _gauges(spark, sf):
    spans = event_spans(spark, sf)
    s = score(spans, carry=DETECT)
    return s, metrics.last_run_gauges(s.summaries, s.findings, last_starts(spans))


def last_run_gauges(spark, sf):
    return _gauges(spark, sf)[1]


def run_costs_over_time(spark, sf):
    return _show_times(metrics.run_costs_over_time(run_summaries(event_spans(spark, sf))))


def alarm_levels(spark, sf):
    s, gauges = _gauges(spark, sf)
    return metrics.alarm_levels(metrics.critical_findings(s.findings), gauges)


# --- reports ---------------------------------------------------------------
def recent_runs_table(spark, sf):
    return _show_times(reports.recent_runs_table(event_spans(spark, sf)))


def all_runs_table(spark, sf):
    return _show_times(reports.run_table(order_spans(spark, sf)))


def run_selector(spark, sf):
    """Newest runs with a tree in the node table, which holds the failed runs here."""

    spans = event_spans(spark, sf)
    failed = spans.where("status = 'error'").select("trace_id").distinct()
    work = Workspace(spark, "selector")
    write_nodes(score(spans.join(failed, "trace_id", "left_semi"), work=work).nodes, f"{work.root}/nodes")
    return _show_times(reports.run_selector(spans, read_nodes(spark, f"{work.root}/nodes")))


def spans_of_failed_labels(spark, sf):
    """Semi join on a label computed per group: spans of runs shown as failed."""

    spans = event_spans(spark, sf)
    failed = reports.run_table(spans).where(F.col("run").contains(" · fail · ")).select("trace_id", "service_name")
    return (
        spans.join(failed, ["trace_id", "service_name"], "left_semi")
        .groupBy("trace_id")
        .agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"))
    )


def runs_of_newest_label(spark, sf):
    """All runs that show the same label as the newest run."""

    runs = reports.run_table(event_spans(spark, sf))
    label = reports.newest(runs, 1).select("run")
    return runs.join(F.broadcast(label), "run", "left_semi").select("trace_id", "run")


def recent_traces(spark, sf):
    return _show_times(recent_runs(event_spans(spark, sf), 50))


def recent_spans(spark, sf):
    return _show_times(reports.recent_spans(event_spans(spark, sf)))


def run_timeline(spark, sf):
    return _show_times(reports.run_timeline(event_spans(spark, sf)))


def run_detail(spark, sf):
    return reports.run_detail(_two_versions(spark, sf))


def sequence_strip(spark, sf):
    return reports.sequence_strip(tables.node_rows(assemble(event_spans(spark, sf))))


def tree_lines(spark, sf):
    return reports.tree_lines(assemble(event_spans(spark, sf)))


def run_text(spark, sf):
    spans = event_spans(spark, sf)
    return reports.run_text(_stored_trees(spark, sf), run_summaries(spans))


def run_json(spark, sf):
    spans = event_spans(spark, sf)
    docs = exports.run_json(_stored_trees(spark, sf), run_summaries(spans))
    doc = F.col("document")
    inside = lambda path: F.get_json_object(doc, path)
    return docs.select(
        "trace_id",
        "part",
        inside("$.span_count").cast("long").alias("span_count"),
        inside("$.summary.step_count").cast("long").alias("step_count"),
        F.coalesce(F.json_array_length(inside("$.orphaned_span_ids")), F.lit(0)).cast("long").alias("orphans"),
        F.json_array_length(inside("$.roots")).cast("long").alias("roots"),
        inside("$.roots[0].span_id").alias("first_root"),
        inside("$.roots[0].children[0].span_id").alias("first_child"),
        inside("$.roots[0].children[0].children[0].span_id").alias("first_grandchild"),
        F.regexp_count(doc, F.lit('"children":')).cast("long").alias("nodes"),
    )


def arrivals(spark, sf):
    return reports.arrivals(event_spans(spark, sf), "support-bot", "2024-01-10 00:00:00")


def handoff_edges(spark, sf):
    return protocols.handoff_edges(event_spans(spark, sf))


def tool_usage(spark, sf):
    return protocols.tool_usage(event_spans(spark, sf)).withColumn("total_ms", F.round("total_ms", 4))


def stamped_handoffs(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stamped = protocols.stamp_handoffs(
        e,
        F.concat(F.lit("u"), F.col("user_id") % 7),
        F.col("event_type"),
        F.when(F.col("event_id") % 2 == 0, F.lit("review")),
    )
    return _stamps(stamped, ("a2a.from", "a2a.to", "a2a.task", "a2a.task_id"))


def stamped_tool_calls(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stamped = protocols.stamp_tool_calls(
        e,
        F.lit("search"),
        F.col("event_type"),
        F.concat(F.lit("t"), F.col("user_id") % 7),
        name=F.when(F.col("event_id") % 5 == 0, F.lit("custom")),
    )
    return _stamps(stamped, ("mcp.server", "mcp.tool", "mcp.transport"))


def _stamps(df, keys):
    got = [F.get_json_object("attributes", f"$['{k}']").alias(k.replace(".", "_")) for k in keys]
    return df.select("event_id", "agent_name", "step_type", "name", *got)


# --- messages and tables ---------------------------------------------------
def _messages(spark, sf) -> DataFrame:
    """Events as span messages, some broken in the ways messages break.

    They are landed first, as a topic would hold them.
    """

    spans = event_spans(spark, sf)
    whole = spans.withColumn("span_id", F.expr("coalesce(span_id, concat('s', seq))"))
    fields = [f for f in exports.MESSAGE_FIELDS if f not in ("tokens_in", "cost_usd", "attributes", "start_time")]
    kind = F.col("seq") % 50
    text = F.to_json(
        F.struct(
            *fields,
            timing.iso_text(F.col("start_time")).alias("start_time"),
            F.expr("try_parse_json(attributes)").alias("attributes"),
            F.when(kind == 1, F.lit("10.5")).when(kind == 2, F.lit("12")).otherwise(F.col("tokens_in").cast("string")).alias("tokens_in"),
            F.when(kind != 3, F.format_string("%.5f", F.col("cost_usd"))).alias("cost_usd"),
        ),
        {"timestampFormat": timing.ISO_FORMAT},
    )
    value = (
        F.when(kind == 4, F.concat(F.lit("["), F.col("text"), F.lit("]")))
        .when(kind == 5, F.expr("substring(text, 1, length(text) - 5)"))
        .when(kind == 6, F.replace(F.col("text"), F.lit('"tokens_out":'), F.lit('"tokens_out":null,"was":')))
        .when(kind == 7, F.replace(F.col("text"), F.lit('"agent_name":'), F.lit('"agent":')))
        .otherwise(F.col("text"))
    )
    sent = whole.withColumn("text", text).select(
        value.alias("value"), F.col("seq").alias("offset"), F.col("ingested_at").alias("timestamp")
    )
    return Workspace(spark, "topic").keep(sent, "messages")


def ingest_good(spark, sf):
    good = messages.good_spans(messages.decode(_messages(spark, sf)))
    return _good(good)


def _good(good):
    return good.select(
        "trace_id", "span_id", "parent_span_id", "step_type", "status", _when("start_time"), _when("end_time"),
        "tokens_in", "tokens_out", "cost_usd",
        F.get_json_object("attributes", "$['mcp.tool']").alias("tool"),
        "redacted", "seq",
    )


def ingest_quarantine(spark, sf):
    bad = messages.quarantined(messages.decode(_messages(spark, sf)))
    return bad.select("seq", "reason")


# Rows of a file that a stream reads; a batch of more rows takes several files.
_FILE_ROWS = 1_000_000


def _files_a_batch(rows: DataFrame, batches: int) -> int:
    return max(1, -(-rows.count() // (batches * _FILE_ROWS)))


def _land(part: DataFrame, files: int, path: str) -> None:
    """Add a batch for a file stream. Rows are dealt to the files, so no task reads or writes a whole batch."""

    part.repartition(files).write.mode("append").parquet(path)


def _message_stream(spark, sf, batches=4):
    """The messages in files of so many batches, as a stream."""

    work = Workspace(spark, "stream")
    landed = _messages(spark, sf)
    files = _files_a_batch(landed, batches)
    for k in range(batches):
        _land(landed.where(F.pmod(F.xxhash64("offset"), F.lit(batches)) == k), files, f"{work.root}/topic")
    return work, spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files).parquet(f"{work.root}/topic")


def _drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_ingest(spark, sf):
    """The same ingest as a streaming query of four bounded batches, merged after every second."""

    work, stream = _message_stream(spark, sf)
    store = tables.SpanStore(spark, f"{work.root}/store")
    _drain(start_ingest(stream, store, f"{work.root}/check", once=True, compact_every=2))
    return _good(store.spans())


def stream_quarantine(spark, sf):
    """Refused messages of the same store, from one read of each batch."""

    work, stream = _message_stream(spark, sf)
    store = tables.SpanStore(spark, f"{work.root}/store")
    _drain(start_ingest(stream, store, f"{work.root}/check", once=True))
    return store.refused().select("seq", "reason")


def store_versions(spark, sf):
    """Rows, runs and data folders of each version: four batches, a merge after the third and the last."""

    work, stream = _message_stream(spark, sf)
    store = tables.SpanStore(spark, f"{work.root}/store")
    _drain(start_ingest(stream, store, f"{work.root}/check", once=True))
    store.compact()
    numbers = store.table.versions()
    first, merged = store.table.version(numbers[0]), store.table.version(numbers[-1])
    # A reader of a version before the merge sees the same rows as one after it.
    shown = [("batches", numbers[-2]), ("merged", numbers[-1])]
    rows = [
        store.spans(version=n).agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("runs"), F.sum("seq").alias("seq_sum"))
        .select(F.lit(name).alias("version"), F.lit(len(store.table.version(n).parts)).cast("long").alias("folders"), "*")
        for name, n in shown
    ]
    assert len(first.parts) == 1 and sum(p.files for p in merged.parts) < sum(p.files for p in store.table.version(numbers[-2]).parts)
    return rows[0].unionByName(rows[1])


def stream_without_repeats(spark, sf):
    """Messages sent twice, the copies in another batch and partly after a restart, kept once."""

    work = Workspace(spark, "repeats")
    spans = event_spans(spark, sf).where("span_id IS NOT NULL").select("trace_id", "span_id", "seq", "ingested_at")
    spans = work.keep(spans, "spans")
    files = _files_a_batch(spans, 3)

    def send(k):
        # Copies come a file after their originals: every third span, by its place.
        fresh, again = spans.where(F.col("seq") % 3 == k), spans.where((F.col("seq") % 3 == k - 1) & (F.col("seq") % 2 == 0))
        _land(fresh.unionByName(again), files, f"{work.root}/topic")

    def run():
        stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", files).parquet(f"{work.root}/topic")
        once = without_repeats(stream, "400 days").writeStream.format("parquet").option("path", f"{work.root}/once")
        _drain(once.option("checkpointLocation", f"{work.root}/check").trigger(availableNow=True).start())

    send(0)
    send(1)
    run()
    send(2)
    send(3)
    run()
    return spark.read.schema(spans.schema).parquet(f"{work.root}/once").select("trace_id", "span_id", "seq")


def topic_messages(spark, sf):
    sent = exports.span_messages(event_spans(spark, sf))
    inside = lambda path: F.get_json_object("value", path)
    return sent.select(
        F.col("key").cast("string").alias("key"),
        inside("$.span_id").alias("span_id"),
        inside("$.status").alias("status"),
        inside("$.attributes['mcp.tool']").alias("tool"),
        inside("$.start_time").alias("start_time"),
    )


def span_table_by_day(spark, sf):
    """Spans written in table layout, then read back with day bounds."""

    work = Workspace(spark, "table")
    tables.write_spans(event_spans(spark, sf), f"{work.root}/spans")
    spans = tables.read_spans(spark, f"{work.root}/spans", since="2024-01-05", until="2024-01-20")
    return (
        spans.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("runs"))
    )


def newest_run_spans(spark, sf):
    """Point read: the newest run's spans with decoded attributes."""

    spans = event_spans(spark, sf)
    run = recent_runs(spans, 1).first()["trace_id"]
    return tables.spans_of_run(spans, run).select(
        "trace_id", "span_id", _when("start_time"), F.size("attributes").cast("long").alias("n_attributes"),
        F.col("attributes").getItem("mcp.tool").alias("tool"), "redacted",
    )


def new_minus_scored(spark, sf):
    """Runs seen but not scored; those that began in the first half count as scored."""

    spans = event_spans(spark, sf)
    starts = last_starts(spans)
    done = starts.where("last_start < '2024-01-15'").select("trace_id", F.lit(0).cast("long").alias("batch"))
    return unscored(spans, done, 1)


def late_after_score(spark, sf):
    spans = event_spans(spark, sf)
    moment = spans.groupBy("trace_id").agg((F.min("ingested_at") + F.expr("interval 30 minutes")).alias("scored_at"))
    return late_spans(spans, moment)


def settled_sessions(spark, sf):
    """Runs' arrival sessions with pauses of at most 20 minutes."""

    return _show_times(settled_runs(event_spans(spark, sf), "20 minutes"))


def _watch(spark, work, spans, arrivals, counter_path=None):
    """Drain a watch over ``arrivals``; the workspace then holds what it stored."""

    query = start_watch(
        arrivals, lambda since, until: spans, f"{work.root}/scored", f"{work.root}/nodes", f"{work.root}/found",
        f"{work.root}/check", quiet="20 minutes", once=True, summary_path=f"{work.root}/summaries",
        counter_path=counter_path,
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _watched_findings(spark, work):
    # A large finding has several documents, of one finding.
    return spark.read.parquet(f"{work.root}/found").select("trace_id", "rule", "severity", "first_visit", "count").distinct()


def stream_watch(spark, sf):
    """Settle-then-score as a streaming query: findings of the runs that settled."""

    work = Workspace(spark, "watch")
    spans = work.keep(event_spans(spark, sf), "spans")
    _watch(spark, work, spans, spark.readStream.schema(spans.schema).parquet(f"{work.root}/001-spans"))
    return _watched_findings(spark, work)


def _arrival_stream(spark, work, spans, batches=3):
    """Arrivals of the spans in files of so many batches, as a stream; later ones bring older arrivals too."""

    files = _files_a_batch(spans, batches)
    for k in range(batches):
        part = spans.where(F.col("seq") % batches == k).select("trace_id", "start_time", "ingested_at")
        _land(part, files, f"{work.root}/arrivals")
    stream = spark.readStream.schema("trace_id string, start_time timestamp, ingested_at timestamp")
    return stream.option("maxFilesPerTrigger", files).parquet(f"{work.root}/arrivals")


def _watched_in_batches(spark, sf, counted=False):
    """A watch over three files; later ones bring older arrivals too."""

    work = Workspace(spark, "watch")
    spans = work.keep(event_spans(spark, sf), "spans")
    stream = _arrival_stream(spark, work, spans)
    _watch(spark, work, spans, stream, f"{work.root}/counters" if counted else None)
    return work


def stream_watch_batches(spark, sf):
    """Findings of all runs that settled after any of three batches, each scored once."""

    return _watched_findings(spark, _watched_in_batches(spark, sf))


def stored_run_costs(spark, sf):
    """The cost histogram from the summaries that the watch stored, batch by batch."""

    work = _watched_in_batches(spark, sf)
    stored = spark.read.parquet(f"{work.root}/summaries")
    return metrics.cost_histogram(stored).withColumn("cost_sum", F.round("cost_sum", 6))


def _counters(spark, sf):
    return Counters(spark, f"{_watched_in_batches(spark, sf, counted=True).root}/counters")


def kept_findings_by_severity(spark, sf):
    """Findings per rule and severity, folded by the watch over three batches."""

    return _counters(spark, sf).findings_by_severity()


def kept_findings_over_time(spark, sf):
    return _show_times(_counters(spark, sf).findings_over_time())


def kept_cost_histogram(spark, sf):
    return _counters(spark, sf).cost_histogram().withColumn("cost_sum", F.round("cost_sum", 6))


def kept_gauges(spark, sf):
    """The gauges of the newest settled run, with both totals, from the folded table."""

    kept = _counters(spark, sf)
    # One row each.
    return kept.last_run_gauges().crossJoin(kept.critical_findings()).crossJoin(kept.runs_evaluated())


def watch_timers(spark, sf):
    """Findings of all runs, each scored once when its own timer fired, over three files of arrivals."""

    work = Workspace(spark, "timers")
    spans = work.keep(event_spans(spark, sf), "spans")
    stream = _arrival_stream(spark, work, spans)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    runs = spans.select("trace_id").where("trace_id IS NOT NULL").distinct().count()
    query = start_timed_watch(
        stream, lambda since, until: spans, f"{work.root}/nodes", f"{work.root}/found", f"{work.root}/check",
        quiet=timedelta(seconds=2), every="1 second",
    )
    try:
        # Silence settles them.
        wait_until_scored(query, spark, f"{work.root}/check", runs, batches=3)
    finally:
        query.stop()
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return _watched_findings(spark, work)


def watch_ignoring_existing(spark, sf):
    """A watch that starts when half of the runs exist: they are never scored."""

    work = Workspace(spark, "ignore")
    spans = work.keep(event_spans(spark, sf), "spans")
    ignore_existing(spans.where("seq < 24 * 100"), f"{work.root}/scored")
    _watch(spark, work, spans, spark.readStream.schema(spans.schema).parquet(f"{work.root}/001-spans"))
    return read_scored(spark, f"{work.root}/scored").select("trace_id", (F.col("batch") < 0).alias("ignored"))


def node_table_snapshots(spark, sf):
    """A node table of two versions, merged, then a third: newest rows as of each of them."""

    work = Workspace(spark, "snapshots")
    path = f"{work.root}/nodes"
    nodes = work.keep(assemble(event_spans(spark, sf), work=work), "nodes")
    renamed = lambda name, part: nodes.where(part).withColumn("name", F.lit(name))
    made = [write_nodes(nodes, path, "2026-01-01 00:00:00")]
    made.append(write_nodes(renamed("second", "order_index % 3 = 0"), path, "2026-01-02 00:00:00"))
    made.append(tables.compact_nodes(spark, path))
    made.append(write_nodes(renamed("third", "order_index % 5 = 0"), path, "2026-01-03 00:00:00"))
    shown = [
        read_nodes(spark, path, version).groupBy(F.when(F.col("name").isin("second", "third"), F.col("name")).otherwise("first").alias("written"))
        .agg(F.count("*").alias("nodes"), F.sum("order_index").alias("places")).select(F.lit(step).cast("long").alias("step"), "*")
        for step, version in enumerate(made)
    ]
    return functools.reduce(DataFrame.unionByName, shown)


# --- cost and redaction ----------------------------------------------------
def conversation_costs(spark, sf):
    return conversation_spans(spark, sf).select(
        "trace_id", "span_id", base_model(F.col("model")).alias("base_model"), "tokens_in", "tokens_out", "cost_usd"
    )


def conversation_summary(spark, sf):
    return _summary(run_summaries(conversation_spans(spark, sf)))


TOKEN_ASSIGNMENT = r"token = \"[^\"]+\""


def redacted_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = redact.redact_value(F.col("text"), (TOKEN_ASSIGNMENT,))
    return d.select("doc_id", F.sha2(text, 256).alias("text_hash"), (text == redact.BLANK).alias("blanked"))


def redacted_messages(spark, sf):
    """Conversation texts with seeded secrets, default patterns only."""

    c = spark.read.parquet(f"{sf}/conversations.parquet")
    seed = (
        F.when(F.col("conv_id") % 6 == 0, F.concat(F.lit("sk-"), F.repeat(F.lit("aB3_"), 6)))
        .when(F.col("conv_id") % 6 == 1, F.concat(F.lit("AKIA"), F.repeat(F.lit("Z9"), 8)))
        .when(F.col("conv_id") % 6 == 2, F.lit("bEaReR \t abcd.efgh-ijkl"))
        .when(F.col("conv_id") % 6 == 3, F.concat(F.lit("ghp_"), F.repeat(F.lit("x1"), 9)))
        .when(F.col("conv_id") % 6 == 4, F.concat(F.lit("xoxb-"), F.repeat(F.lit("12-"), 4)))
        .otherwise(F.lit(""))
    )
    text = redact.redact_value(F.concat(F.col("text"), F.lit(" "), seed))
    return c.select("conv_id", "turn", F.sha2(text, 256).alias("text_hash"))


_KEY_ENDINGS = ("Token", "-API-Key", "_count", " passwd", "_id")


def sensitive_keys(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ending = F.get(F.array(*map(F.lit, _KEY_ENDINGS)), (F.col("event_id") % 5).cast("int"))
    key = F.concat("event_type", ending)
    return (
        e.select(key.alias("key"), redact.key_is_sensitive(key, ("sign-UP_i",)).alias("sensitive"))
        .groupBy("key", "sensitive")
        .agg(F.count("*").alias("n"))
    )


def redacted_map(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    attributes = F.create_map(
        F.lit("user_password"), F.col("user_id").cast("string"),
        F.lit("note"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("use AIza"), F.repeat(F.lit("q7"), 10))).otherwise(F.col("props")),
        F.lit("kind"), F.col("event_type"),
    )
    clean = redact.redact_map(attributes)
    return e.select("event_id", *[clean.getItem(k).alias(k) for k in ("user_password", "note", "kind")])


def redacted_nested_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(
        F.lit('{"user":{"name":"'), "event_type", F.lit('","Session-ID":'), F.col("event_id").cast("string"),
        F.lit('},"tags":["'), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("AKIA"), F.repeat(F.lit("A1"), 8))).otherwise(F.lit("plain")),
        F.lit('",["'), F.when(F.col("event_id") % 5 == 0, F.lit("Bearer abcdefgh1")).otherwise(F.lit("inner")),
        F.lit('"]],"n":'), F.col("user_id").cast("string"), F.lit("}"),
    )
    clean = redact.redact_json(text)
    inside = lambda path, name: F.get_json_object("clean", path).alias(name)
    return e.select("event_id", clean.alias("clean")).select(
        "event_id",
        inside("$.user.name", "name"),
        inside("$.user['Session-ID']", "session"),
        inside("$.tags[0]", "tag"),
        inside("$.tags[1][0]", "inner_tag"),
        inside("$.n", "n"),
    )


def redacted_hard_json(spark, sf):
    """JSON with a number of 5,000 digits, a key forty levels down, or a comma too many."""

    e = spark.read.parquet(f"{sf}/events.parquet")
    secret = F.concat(F.lit('{"user_password":"pw-'), F.col("event_id").cast("string"), F.lit('"'))
    number = F.concat(secret, F.lit(',"n":'), F.repeat(F.lit("7"), 5000), F.lit("}"))
    deep = F.concat(F.repeat(F.lit('{"a":'), 40), secret, F.repeat(F.lit("}"), 41))
    text = F.when(F.col("event_id") % 3 == 0, number).when(F.col("event_id") % 3 == 1, deep).otherwise(F.concat(secret, F.lit(",}")))
    clean = e.select("event_id", redact.redact_json(text).alias("clean"))
    return clean.select(
        "event_id",
        F.contains("clean", F.lit("pw-")).alias("leaks"),
        F.length(F.regexp_extract("clean", "(7{100,})", 1)).cast("long").alias("digits"),
        F.regexp_count("clean", F.lit('"a":')).cast("long").alias("levels"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        span_view, run_summary, run_summary_orders, span_last_copy, contract_violations,
        tree_nodes, tree_nodes_orders, walked_places, orphans_anti_join, orphan_list, node_table_rows, node_latest_version,
        runaway_loops, tool_failures, cost_spikes, findings, findings_orders, added_rule, failed_tool_calls, top_spans,
        evidence_spans, finding_documents, finding_json, finding_lines, one_shot_score,
        findings_by_severity, critical_findings, findings_over_time, runs_evaluated, cost_histogram,
        last_run_gauges, run_costs_over_time, alarm_levels,
        recent_runs_table, all_runs_table, run_selector, spans_of_failed_labels, runs_of_newest_label,
        recent_traces, recent_spans, run_timeline, run_detail, sequence_strip, tree_lines, run_text, run_json,
        arrivals, handoff_edges, tool_usage, stamped_handoffs, stamped_tool_calls,
        ingest_good, ingest_quarantine, stream_ingest, stream_quarantine, store_versions, stream_without_repeats, topic_messages, span_table_by_day, newest_run_spans,
        new_minus_scored, late_after_score, settled_sessions, stream_watch, stream_watch_batches, stored_run_costs,
        kept_findings_by_severity, kept_findings_over_time, kept_cost_histogram, kept_gauges,
        watch_timers, watch_ignoring_existing, node_table_snapshots,
        conversation_costs, conversation_summary,
        redacted_documents, redacted_messages, sensitive_keys, redacted_map, redacted_nested_json, redacted_hard_json,
    )
}
