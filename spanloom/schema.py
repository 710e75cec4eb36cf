"""The span contract: stored columns, enums and the derived node columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# Fixed values of the span contract.
STEP_TYPES = ("llm_call", "tool_call", "a2a_handoff", "decision")
STATUSES = ("ok", "error")
REQUIRED_FIELDS = (
    "trace_id",
    "span_id",
    "service_name",
    "agent_name",
    "step_type",
    "name",
    "start_time",
    "status",
)
# Token counters are unsigned 32-bit at rest.
MAX_TOKENS = 4294967295

# Costs are added up as exact decimals, so a run's total (and with it a
# threshold test) never depends on the order in which tasks finish.
# Twenty digits before the point; sums have thirty.
COST_DECIMAL = "decimal(28,8)"
TIME_DECIMAL = "decimal(24,6)"

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("step_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("redacted", T.BooleanType()),
        T.StructField("ingested_at", T.TimestampType()),
        # Arrival position within a batch or topic partition; breaks ties that
        # the order of a list would break in a single process.
        T.StructField("seq", T.LongType()),
    ]
)

SPAN_COLUMNS = tuple(f.name for f in SPAN_SCHEMA)

# Span columns a tree node keeps besides ids and position.
NODE_PAYLOAD = (
    "agent_name",
    "step_type",
    "name",
    "duration_ms",
    "cost_usd",
    "status",
    "error_message",
    "attributes",
)

NODE_TABLE_COLUMNS = (
    "trace_id",
    "span_id",
    "parent_span_id",
    "order_index",
    "depth",
    *NODE_PAYLOAD,
    "orphaned",
    "written_at",
)


def conform(spans: DataFrame) -> DataFrame:
    """Give ``spans`` every span column, in order and with the right type.

    Columns that are absent become NULL. Spark's column pruning drops again
    whatever an operator does not read.
    """

    have = set(spans.columns)
    return spans.selectExpr(
        *[
            f"cast({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in SPAN_SCHEMA
        ]
    )
