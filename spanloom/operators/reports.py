"""Ready-to-query reports over spans and the node table.

Panels that show one run take its ``trace_id``: display labels may repeat, so
they are shown but not used to select. Without an id they cover all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions import text
from spanloom.operators.dedupe import latest_nodes
from spanloom.schema import COST_DECIMAL

# Most entries (lines, boxes, ids) put together in one text value.
PART = 5_000


def _one(df: DataFrame, trace_id: str | None) -> DataFrame:
    return df if trace_id is None else df.where(F.col("trace_id") == F.lit(trace_id))


def _sorted(ordered: bool | None, trace_id: str | None) -> bool:
    return trace_id is not None if ordered is None else ordered


def _cost(column: str = "cost_usd") -> Column:
    return F.coalesce(F.col(column).try_cast(COST_DECIMAL), F.lit(0))


def run_table(spans: DataFrame) -> DataFrame:
    """Per run and service: label, steps, cost, errors, last seen."""

    return (
        spans.groupBy("trace_id", "service_name")
        .agg(
            F.count("*").alias("steps"),
            F.round(F.sum(_cost()), 4).cast("double").alias("cost_usd"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.max("start_time").alias("last_seen"),
        )
        .select(
            "trace_id",
            "service_name",
            text.run_label(F.col("service_name"), F.col("errors"), F.col("last_seen")).alias("run"),
            "steps",
            "cost_usd",
            "errors",
            "last_seen",
        )
    )


def newest(df: DataFrame, limit: int, by: str = "last_seen", ties: tuple[str, ...] = ("trace_id", "service_name")) -> DataFrame:
    """The ``limit`` newest rows; ``ties`` make the choice unique."""

    order = [F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return df.orderBy(*order).limit(limit)


def recent_runs_table(spans: DataFrame, limit: int = 30) -> DataFrame:
    return newest(run_table(spans), limit)


def run_selector(spans: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs that have an assembled tree, with their labels.

    Ids of assembled runs are made distinct before the semi join, so a large
    run's nodes do not all travel.
    """

    assembled = nodes.select("trace_id").distinct()
    runs = run_table(spans).join(assembled, "trace_id", "left_semi")
    return newest(runs, limit).select("trace_id", "service_name", "run", "last_seen")


def runs_with_label(spans: DataFrame, label: str) -> DataFrame:
    """All runs that show as ``label``; there may be several."""

    return run_table(spans).where(F.col("run") == F.lit(label)).select("trace_id").distinct()


def recent_spans(spans: DataFrame, limit: int = 50) -> DataFrame:
    picked = newest(spans, limit, "start_time", ("trace_id", "span_id", "seq"))
    return picked.select(
        "start_time", "agent_name", "step_type", "name", "status", text.rounded(F.col("cost_usd"), 4).alias("cost_usd")
    )


def run_detail(nodes: DataFrame, trace_id: str | None = None, ordered: bool | None = None) -> DataFrame:
    """The tree as an indented table, newest version of each node.

    Sorted when one run is chosen; all runs are not, unless ``ordered`` says so.
    """

    rows = latest_nodes(_one(nodes, trace_id)).select(
        "trace_id",
        "order_index",
        text.indented(F.col("name"), F.col("depth")).alias("step"),
        "agent_name",
        "step_type",
        text.step_detail(F.col("step_type"), F.col("attributes")).alias("detail"),
        text.rounded(F.col("duration_ms"), 1).alias("duration_ms"),
        text.rounded(F.col("cost_usd"), 6).alias("cost_usd"),
        "status",
        "attributes",
    )
    return rows.orderBy("trace_id", "order_index") if _sorted(ordered, trace_id) else rows


def run_timeline(spans: DataFrame, trace_id: str | None = None, ordered: bool | None = None) -> DataFrame:
    """Durations over time, in one column per outcome; sorted as ``run_detail``."""

    took = text.rounded(F.col("duration_ms"), 2)
    rows = _one(spans, trace_id).select(
        "trace_id",
        "span_id",
        F.col("start_time").alias("time"),
        F.when(F.col("status") == "ok", took).alias("ok"),
        F.when(F.col("status") == "error", took).alias("error"),
    )
    return rows.orderBy("time", "trace_id", "span_id") if _sorted(ordered, trace_id) else rows


def sequence_strip(nodes: DataFrame, trace_id: str | None = None, part: int = PART) -> DataFrame:
    """A run's steps in execution order as one line of boxes.

    Runs of more than ``part`` steps continue in further rows; joining the rows
    with the arrow gives the whole line.
    """

    box = F.concat(
        F.lit("["),
        (F.col("order_index") + 1).cast("string"), F.lit(". "), F.col("step_type"), F.lit(" | "),
        F.col("agent_name"), F.lit(" | "), text.tidy_name(F.col("name")), F.lit(" | "),
        text.fixed(F.col("duration_ms"), 1), F.lit(" ms | $"), text.fixed(F.col("cost_usd"), 6), F.lit(" | "),
        F.when(F.col("status") == "error", F.lit("ERROR")).otherwise(F.lit("ok")),
        F.when(
            (F.col("status") == "error") & (F.coalesce("error_message", F.lit("")) != ""),
            F.concat(F.lit(": "), text.tidy_message(F.col("error_message"))),
        ).otherwise(F.lit("")),
        F.lit("]"),
    )
    rows = latest_nodes(_one(nodes, trace_id)).select("trace_id", "order_index", box.alias("piece"))
    return joined_pieces(rows, " → ", part, "strip")


def joined_pieces(rows: DataFrame, separator: str, part: int, into: str) -> DataFrame:
    """Join each run's ``piece`` texts by ``order_index``, at most ``part`` to a row."""

    ordered = F.sort_array(F.collect_list(F.struct("order_index", "piece")))
    return (
        rows.withColumn("part", F.floor(F.col("order_index") / part))
        .groupBy("trace_id", "part")
        .agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), separator).alias(into))
    )


def tree_lines(nodes: DataFrame) -> DataFrame:
    """One line of text per node; order by ``order_index`` within a run."""

    columns = {
        c: F.col(c)
        for c in ("depth", "duration_ms", "status", "agent_name", "step_type", "name", "cost_usd", "orphaned")
    }
    return nodes.select("trace_id", "order_index", text.tree_line(columns).alias("line"))


_RULE = "=" * 60


def run_text(nodes: DataFrame, summaries: DataFrame, part: int = PART) -> DataFrame:
    """A run as readable text: header, tree, totals, orphans.

    ``section`` and ``part`` order the rows of a run: 0 is the header, 1 the
    tree, 2 the totals, 3 the orphaned span ids. Only sections 1 and 3 can take
    more than one row.
    """

    tree = joined_pieces(tree_lines(nodes).withColumnRenamed("line", "piece"), "\n", part, "text")
    size = nodes.groupBy("trace_id").agg(F.count("*").alias("spans"))
    head = size.select(
        "trace_id",
        F.concat(F.lit("Trace "), "trace_id", F.lit(" -- "), F.col("spans").cast("string"), F.lit(f" spans\n{_RULE}")).alias("text"),
    )
    n = lambda c: F.col(c).cast("string")
    foot = summaries.select(
        "trace_id",
        F.concat(
            F.lit(f"{_RULE}\ncost $"), text.fixed(F.col("total_cost_usd"), 4), F.lit(" | "), n("total_tokens"),
            F.lit(" tokens ("), n("total_tokens_in"), F.lit(" in / "), n("total_tokens_out"), F.lit(" out)\nwall-clock "),
            text.whole(F.col("wall_clock_ms")), F.lit("ms | compute "), text.whole(F.col("sum_step_ms")), F.lit("ms | "),
            n("step_count"), F.lit(" steps | "), n("agent_count"), F.lit(" agents | "), n("error_count"), F.lit(" errors"),
        ).alias("text"),
    )
    lost = joined_pieces(
        nodes.where("orphaned").select("trace_id", "order_index", F.col("span_id").alias("piece")), ", ", part, "text"
    ).withColumn("text", F.concat(F.lit("orphaned spans (missing parent): "), "text"))

    def section(df, number):
        part_no = F.col("part") if "part" in df.columns else F.lit(0).cast("long")
        return df.select("trace_id", F.lit(number).alias("section"), part_no.alias("part"), "text")

    rows = section(head, 0)
    for number, df in enumerate((tree, foot, lost), 1):
        rows = rows.unionByName(section(df, number))
    return rows


def finding_lines(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings as text lines, and a ``clean`` line for every run without any.

    Within a run, lines follow ``rule_no, first_visit, part``.
    """

    lines = documents.select(
        "trace_id",
        "rule_no",
        "first_visit",
        "part",
        F.concat(
            F.lit("  ["), F.rpad(F.upper("severity"), 8, " "), F.lit("] "), "rule", F.lit(": "), "summary",
            F.lit("\n             spans: "), F.array_join("span_ids", ", "),
        ).alias("line"),
    )
    found = documents.select("trace_id", "rule", "first_visit").distinct().groupBy("trace_id").agg(
        F.count("*").alias("n")
    )
    heads = runs.select("trace_id").join(found, "trace_id", "left").select(
        "trace_id",
        F.lit(0).alias("rule_no"),
        F.lit(0).cast("long").alias("first_visit"),
        F.lit(0).cast("long").alias("part"),
        F.when(
            F.col("n").isNull(), F.concat(F.lit("Trace "), "trace_id", F.lit(": clean — no findings."))
        ).otherwise(
            F.concat(F.lit("Trace "), "trace_id", F.lit(": "), F.col("n").cast("string"), F.lit(" finding(s)"))
        ).alias("line"),
    )
    return heads.unionByName(lines)


def arrivals(spans: DataFrame, service: str, since) -> DataFrame:
    """Spans and runs of a service that arrived since a moment."""

    return spans.where(
        (F.col("service_name") == F.lit(service)) & (F.col("ingested_at") >= F.lit(since).cast("timestamp"))
    ).agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("runs"))
