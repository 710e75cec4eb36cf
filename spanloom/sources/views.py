"""Span-shaped views over the driver's tables, for queries and benches.

All are narrow projections: no shuffle, and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.functions.cost import estimate_tokens, price_calls
from spanloom.schema import conform

BLOCK = 24  # consecutive events that make one run, or three runs of eight


def _utc(column: str) -> str:
    # The tables store zoneless timestamps, which are UTC.
    return f"to_utc_timestamp(cast({column} AS timestamp), current_timezone())"


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as spans of runs cut from blocks of consecutive events.

    Every third block is three runs of 8 spans, the others one run of 24. The
    parent of position p is position ⌊(p−1)/2⌋; in every fifth block it is p−1,
    a chain. The data also gets what real streams have: missing parents, spans
    without id, late starts, missing starts and ends, and (every seventh block)
    a parent cycle between positions 0 and 2.
    """

    placed = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .selectExpr("*", f"event_id div {BLOCK} AS block", f"event_id % {BLOCK} AS at")
        .selectExpr(
            "*",
            "if(block % 3 = 0, at div 8, 0) AS sub",
            "if(block % 3 = 0, at % 8, at) AS p",
        )
        .selectExpr(
            "*",
            "event_id - p + if(block % 5 = 0, p - 1, (p - 1) div 2) AS parent",
            f"""if(event_id % 211 = 0, NULL, {_utc('ts')}
                  - if(event_id % 11 = 0, interval 1 hour, interval 0 hour)) AS start""",
            "concat('agent', event_id % 3) AS receiver",
            "concat('tool', event_id % 2) AS tool",
        )
    )
    return conform(
        placed.selectExpr(
            "concat('r', block, '-', sub) AS trace_id",
            "if(event_id % 89 = 0, NULL, concat('s', event_id)) AS span_id",
            """CASE WHEN p = 0 AND block % 7 = 3 THEN concat('s', event_id + 2)
                    WHEN p = 0 THEN NULL
                    WHEN event_id % 97 = 0 THEN concat('ghost-', event_id)
                    ELSE concat('s', parent) END AS parent_span_id""",
            "if(block % 2 = 0, 'research-desk', 'support-bot') AS service_name",
            """CASE event_type WHEN 'signup' THEN 'orchestrator' WHEN 'purchase' THEN 'summarizer'
                    ELSE 'search' END AS agent_name""",
            """CASE WHEN event_type = 'signup' THEN 'decision'
                    WHEN event_type IN ('click', 'error') THEN 'tool_call'
                    WHEN event_type = 'view' THEN 'llm_call' ELSE 'a2a_handoff' END AS step_type""",
            """CASE WHEN event_type = 'signup' THEN 'orchestrate'
                    WHEN event_type IN ('click', 'error') THEN concat('search-tools.', tool)
                    WHEN event_type = 'view' THEN 'extract'
                    ELSE concat('a2a: summarizer -> ', receiver) END AS name""",
            "start AS start_time",
            """if(event_id % 13 = 0, NULL,
                  start + make_dt_interval(0, 0, 0, cast(round(value, 2) AS decimal(18,6)))) AS end_time""",
            "if(event_id % 10 = 0, NULL, value) AS duration_ms",
            "if(event_type = 'error', 'error', 'ok') AS status",
            "if(event_type = 'error', 'malformed \"tool\" response', NULL) AS error_message",
            "if(event_type = 'view', 'us.model-a', NULL) AS model",
            "if(event_type = 'view', floor(value), 0) AS tokens_in",
            "if(event_type = 'view', floor(value / 2), 0) AS tokens_out",
            "value / 200 AS cost_usd",
            """CASE WHEN event_type = 'purchase' THEN concat(
                      '{"a2a.from":"summarizer","a2a.to":"', receiver, '","a2a.task":"review"}')
                    WHEN event_type IN ('click', 'error') THEN concat(
                      '{"mcp.server":"search-tools","mcp.tool":"', tool, '","mcp.transport":"stdio"}')
                    ELSE props END AS attributes""",
            "true AS redacted",
            f"{_utc('ts')} AS ingested_at",
            "event_id AS seq",
        )
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as roots and their ``lineitem`` rows as tool calls.

    Line numbers repeat within an order, so span ids come in copies.
    """

    roots = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('o', o_orderkey) AS trace_id",
        "concat('o', o_orderkey) AS span_id",
        "cast(NULL AS string) AS parent_span_id",
        "'orchestrator' AS agent_name",
        "'decision' AS step_type",
        "'orchestrate' AS name",
        f"{_utc('o_orderdate')} AS start_time",
        "'ok' AS status",
        "0D AS duration_ms",
        "0D AS cost_usd",
    )
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('o', l_orderkey) AS trace_id",
        "concat('o', l_orderkey, '-', l_linenumber) AS span_id",
        "concat('o', l_orderkey) AS parent_span_id",
        "'search' AS agent_name",
        "'tool_call' AS step_type",
        "concat('tool.', l_returnflag, l_linestatus) AS name",
        f"{_utc('l_shipdate')} AS start_time",
        "if(l_returnflag = 'R', 'error', 'ok') AS status",
        "l_quantity AS duration_ms",
        "l_extendedprice * l_discount / 10000 AS cost_usd",
    )
    return conform(roots.unionByName(calls).selectExpr("*", "'orders' AS service_name"))


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as model calls, priced by estimated tokens.

    Turns have no times; minute ``turn`` of a fixed day keeps their order.
    """

    calls = (
        spark.read.parquet(f"{sf_dir}/conversations.parquet")
        .withColumn("tokens", estimate_tokens(F.col("text")))
        .selectExpr(
            "concat('c', conv_id) AS trace_id",
            "concat('c', conv_id, '-', turn) AS span_id",
            "if(turn > 0, concat('c', conv_id, '-', turn - 1), NULL) AS parent_span_id",
            "'chat' AS service_name",
            "role AS agent_name",
            "'llm_call' AS step_type",
            "concat('turn by ', role) AS name",
            "timestamp_seconds(1704067200 + turn * 60) AS start_time",
            "'ok' AS status",
            "if(conv_id % 2 = 0, 'eu.anthropic.claude-haiku-4-5-20251001-v1:0', NULL) AS model",
            "if(role = 'assistant', 0, tokens) AS tokens_in",
            "if(role = 'assistant', tokens, 0) AS tokens_out",
            "turn AS seq",
        )
    )
    return conform(price_calls(calls))
