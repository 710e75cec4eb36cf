"""JSON out: span messages, whole runs, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.timing import ISO_FORMAT, iso_text
from spanloom.operators.reports import PART, joined_pieces

_KEEP_NULLS = {"ignoreNullFields": "false", "timestampFormat": ISO_FORMAT}

MESSAGE_FIELDS = (
    "service_name",
    "agent_name",
    "step_type",
    "name",
    "trace_id",
    "span_id",
    "parent_span_id",
    "start_time",
    "end_time",
    "status",
    "error_message",
    "model",
    "tokens_in",
    "tokens_out",
    "cost_usd",
    "attributes",
    "redacted",
    "duration_ms",
)


def json_value(text: str) -> str:
    """SQL: JSON text as a value; text that is not valid JSON stays, as a JSON string."""

    return f"coalesce(try_parse_json({text}), parse_json(to_json({text}::variant)))"


def span_messages(spans: DataFrame) -> DataFrame:
    """Spans as topic records: JSON text keyed by run, so a run keeps one partition.

    Attributes go in as JSON, not as quoted text.
    """

    fields = [
        F.expr(json_value("attributes")).alias(f) if f == "attributes" else F.col(f)
        for f in MESSAGE_FIELDS
    ]
    return spans.select(
        F.nullif("trace_id", F.lit("")).cast("binary").alias("key"),
        F.to_json(F.struct(*fields), _KEEP_NULLS).alias("value"),
    )


def write_to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish span messages. Needs Spark's Kafka package on the class path."""

    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def summary_json(summary: DataFrame) -> Column:
    """A run summary as JSON, bounds in ISO form."""

    fields = [
        F.col(c).cast("double").alias(c) if c == "total_cost_usd" else F.col(c)
        for c in summary.columns
        if c != "unusable_costs"
    ]
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def finding_json(documents: DataFrame) -> DataFrame:
    """Findings as JSON documents (see ``detect.finding_documents``)."""

    body = F.struct(
        "rule",
        "severity",
        "trace_id",
        "summary",
        "span_ids",
        F.expr("try_parse_json(evidence)").alias("evidence"),
    )
    return documents.select("trace_id", "rule_no", "first_visit", "part", F.to_json(body).alias("document"))


def run_json(nodes: DataFrame, summaries: DataFrame, part: int = PART) -> DataFrame:
    """Whole runs as nested JSON: summary, orphans, and the tree with children
    inside their parents.

    In pre-order, what closes after a node follows from its own depth and the
    next one's, so the nested text is the concatenation of one fragment per
    node; no tree is built. A run of at most ``part`` nodes is one row (part 0);
    a larger one comes as rows whose texts, in ``part`` order, join to the
    document. ``nodes`` needs the span columns to show; ``attributes`` become
    nested JSON. It is read several times: pass stored nodes, as ``score`` gives.
    """

    hidden = {"trace_id", "order_index", "visit_index", "promoted"}
    shown = [
        F.expr(json_value("attributes")).alias(c)
        if c == "attributes"
        else iso_text(F.col(c)).alias(c)
        if t == "timestamp"
        else F.col(c)
        for c, t in nodes.dtypes
        if c not in hidden
    ]
    body = F.to_json(F.struct("trace_id", *shown), _KEEP_NULLS)
    opened = nodes.withColumn("body", body).select(
        "trace_id",
        "order_index",
        "depth",
        F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"children":[')).alias("open"),
    )

    # A part's last node needs the depth of the next part's first: that one is
    # sent to both parts, marked by its place beyond the part.
    home = F.floor(F.col("order_index") / part)
    parts = F.when(
        (F.col("order_index") % part == 0) & (F.col("order_index") > 0), F.array(home - 1, home)
    ).otherwise(F.array(home))
    gathered = (
        opened.withColumn("part", F.explode(parts))
        .groupBy("trace_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("order_index", "depth", "open"))).alias("run"))
    )
    fragment = f"""
        if(n.order_index >= (part + 1) * {part}, '',
           concat(n.open,
             CASE WHEN get(run, i + 1) IS NULL THEN repeat(']}}', n.depth + 1)
                  WHEN get(run, i + 1).depth > n.depth THEN ''
                  ELSE concat(repeat(']}}', n.depth - get(run, i + 1).depth + 1), ',') END))"""
    tree = gathered.select(
        "trace_id", "part", F.expr(f"array_join(transform(run, (n, i) -> {fragment}), '')").alias("text")
    )

    size = nodes.groupBy("trace_id").agg(F.count("*").alias("span_count"))
    lost = nodes.where("orphaned").withColumn("ids", F.to_json(F.array("span_id"))).select(
        "trace_id", "order_index", F.expr("substring(ids, 2, length(ids) - 2)").alias("piece")
    )
    orphans = joined_pieces(lost, ",", part, "text")
    first = orphans.groupBy("trace_id").agg(F.min("part").alias("first_part"))
    orphans = orphans.join(first, "trace_id").select(
        "trace_id",
        "part",
        F.when(F.col("part") > F.col("first_part"), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"),
    )
    opening = F.to_json(F.struct("trace_id"))
    head = summaries.withColumns({"summary": summary_json(summaries), "opening": opening}).join(size, "trace_id", "left").select(
        "trace_id",
        F.concat(
            F.expr("substring(opening, 1, length(opening) - 1)"),
            F.lit(',"span_count":'), F.coalesce("span_count", F.lit(0)).cast("string"),
            F.lit(',"summary":'), "summary", F.lit(',"orphaned_span_ids":['),
        ).alias("text"),
    )
    zero = F.lit(0).cast("long")
    pieces = (
        head.select("trace_id", F.lit(0).alias("section"), zero.alias("part"), "text")
        .unionByName(orphans.select("trace_id", F.lit(1).alias("section"), "part", "text"))
        .unionByName(summaries.select("trace_id", F.lit(2).alias("section"), zero.alias("part"), F.lit('],"roots":[').alias("text")))
        .unionByName(tree.select("trace_id", F.lit(3).alias("section"), "part", "text"))
        .unionByName(summaries.select("trace_id", F.lit(4).alias("section"), zero.alias("part"), F.lit("]}").alias("text")))
    )
    # Small runs gather all their pieces in row 0; larger ones keep them apart.
    sized = pieces.join(size.withColumnRenamed("trace_id", "_t"), F.col("trace_id") == F.col("_t"), "left")
    row = F.when(F.coalesce("span_count", F.lit(0)) <= part, zero).otherwise(
        F.shiftleft(F.col("section").cast("long"), 48) + F.col("part") + 1
    )
    ordered = F.sort_array(F.collect_list(F.struct("section", "part", "text")))
    return (
        sized.select("trace_id", row.alias("row"), "section", F.col("part"), "text")
        .groupBy("trace_id", "row")
        .agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("document"))
        .withColumnRenamed("row", "part")
    )
