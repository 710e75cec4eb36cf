"""Agent handoffs and tool calls: stamping their attributes, reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.text import attribute

DEFAULT_TRANSPORT = "stdio"


def _label(name: Column | None, fallback: Column) -> Column:
    return fallback if name is None else F.coalesce(F.nullif(name, F.lit("")), fallback)


def _stamped(marks: dict[str, Column | None], attributes: Column | None) -> Column:
    """Attribute JSON with the protocol's marks; they win over attributes of the same name."""

    entries = [x for k, v in marks.items() if v is not None for x in (F.lit(k), v)]
    own = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    if attributes is not None:
        more = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
        own = F.map_concat(F.map_filter(more, lambda k, v: ~k.isin(*marks)), own)
    return F.to_json(own)


def stamp_handoffs(
    df: DataFrame,
    sender: Column,
    receiver: Column,
    task: Column | None = None,
    task_id: Column | None = None,
    name: Column | None = None,
    attributes: Column | None = None,
) -> DataFrame:
    """Make rows handoff spans: agent, step type, label and ``a2a.*`` attributes.

    NULL tasks are left out. ``attributes`` is a map of further ones.
    """

    stamped = _stamped(
        {"a2a.from": sender, "a2a.to": receiver, "a2a.task": task, "a2a.task_id": task_id}, attributes
    )
    label = _label(name, F.concat(F.lit("a2a: "), sender, F.lit(" -> "), receiver))
    return df.withColumns(
        {
            "agent_name": sender,
            "step_type": F.lit("a2a_handoff"),
            "name": label,
            "attributes": stamped,
        }
    )


def stamp_tool_calls(
    df: DataFrame,
    agent: Column,
    server: Column,
    tool: Column,
    transport: Column | None = None,
    name: Column | None = None,
    attributes: Column | None = None,
) -> DataFrame:
    """Make rows tool-call spans: agent, step type, label and ``mcp.*`` attributes."""

    how = F.lit(DEFAULT_TRANSPORT) if transport is None else F.coalesce(transport, F.lit(DEFAULT_TRANSPORT))
    stamped = _stamped({"mcp.server": server, "mcp.tool": tool, "mcp.transport": how}, attributes)
    return df.withColumns(
        {
            "agent_name": agent,
            "step_type": F.lit("tool_call"),
            "name": _label(name, F.concat(server, F.lit("."), tool)),
            "attributes": stamped,
        }
    )


def handoff_edges(spans: DataFrame) -> DataFrame:
    """Who handed to whom how often, per run."""

    return (
        spans.where("step_type = 'a2a_handoff'")
        .select(
            "trace_id",
            attribute(F.col("attributes"), "a2a.from").alias("from_agent"),
            attribute(F.col("attributes"), "a2a.to").alias("to_agent"),
            "status",
        )
        .groupBy("trace_id", "from_agent", "to_agent")
        .agg(
            F.count("*").alias("handoffs"),
            F.count_if(F.col("status") == "error").alias("failed"),
        )
    )


def tool_usage(spans: DataFrame) -> DataFrame:
    """Calls, failures and time per tool and transport, over all runs."""

    return (
        spans.where("step_type = 'tool_call'")
        .select(
            attribute(F.col("attributes"), "mcp.server").alias("server"),
            attribute(F.col("attributes"), "mcp.tool").alias("tool"),
            F.coalesce(F.nullif(attribute(F.col("attributes"), "mcp.transport"), F.lit("")), F.lit(DEFAULT_TRANSPORT)).alias(
                "transport"
            ),
            "status",
            F.coalesce("duration_ms", F.lit(0.0)).cast("decimal(24,6)").alias("ms"),
        )
        .groupBy("server", "tool", "transport")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("status") == "error").alias("failed"),
            F.sum("ms").cast("double").alias("total_ms"),
        )
        .withColumn("label", F.concat("server", F.lit("."), "tool"))
    )
