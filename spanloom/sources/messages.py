"""Span messages: JSON in, typed rows or a quarantine reason out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.timing import USUAL_PATTERN, parse_timestamp
from spanloom.schema import MAX_TOKENS, REQUIRED_FIELDS, SPAN_COLUMNS, STATUSES, STEP_TYPES

_TEXTS = (
    "trace_id",
    "span_id",
    "parent_span_id",
    "service_name",
    "agent_name",
    "step_type",
    "name",
    "status",
    "error_message",
    "model",
)
_TIMES = ("start_time", "end_time")
_COUNTS = ("tokens_in", "tokens_out")
_TYPED = (*_TIMES, *_COUNTS, "duration_ms", "cost_usd")
_SCALARS = (*_TEXTS, *_TYPED)
_FIELDS = (*_SCALARS, "attributes", "redacted")


MAX_PER_TRIGGER = 1_000_000


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = MAX_PER_TRIGGER) -> DataFrame:
    """The span topic from its beginning; the query's checkpoint keeps offsets.

    A batch takes at most ``max_per_trigger`` messages (None: all there are), so
    the first batches after a long pause stay bounded; the rest follow.

    Needs Spark's Kafka package on the class path.
    """

    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def decode(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Every message with its span columns and ``reason``, NULL when it is good.

    ``messages`` has ``value`` (text or bytes) and, if known, ``offset`` and
    ``timestamp``. A message is bad when it is not a JSON object, a required
    field is missing, a time does not parse, or a number is no number; absent
    numbers are 0, explicit nulls are bad. ``strict`` also checks step type and
    status against the contract.

    One pass, no Python. Fields are taken as text, which settles nearly every
    message; only where the answer hangs on a value's JSON type (was this 10.5
    or "10.5"?) is the message parsed a second time, as a VARIANT. Text fields
    that hold an object keep it as JSON text.
    """

    have = set(messages.columns)
    raw = messages.select(
        F.col("value").cast("string").alias("value"),
        (F.col("offset") if "offset" in have else F.lit(None)).cast("long").alias("seq"),
        (F.col("timestamp") if "timestamp" in have else F.current_timestamp()).cast("timestamp").alias("ingested_at"),
    )
    schema = ", ".join(f"{f} string" for f in (*_FIELDS, "_malformed"))
    doc = raw.selectExpr(
        "*",
        f"from_json(value, '{schema}', map('columnNameOfCorruptRecord', '_malformed')) AS doc",
        # NULL unless the message is an object.
        "json_object_keys(value) AS given",
    )
    parts = doc.selectExpr(
        "value",
        "seq",
        "ingested_at",
        "given",
        "given IS NOT NULL AND doc._malformed IS NULL AS is_object",
        *[f"doc.{f} AS t_{f}" for f in _FIELDS],
    )
    typed = parts.withColumns(
        {
            **{f: _timestamp(f) for f in _TIMES},
            **{f: _integer(f) for f in _COUNTS},
            "duration_ms": F.expr(f"if(t_duration_ms RLIKE r'{_DECIMAL}', double(t_duration_ms), NULL)"),
            "cost_usd": _number("cost_usd"),
            "redacted": _truth("redacted"),
            "attributes": F.expr(
                "coalesce(t_attributes, if(array_contains(given, 'attributes'), 'null', '{}'))"
            ),
        }
    )

    # Whatever is wrong first is the reason.
    problems = [("NOT is_object", "not a JSON object")]
    problems += [(f"t_{f} IS NULL", f"{f}: missing") for f in REQUIRED_FIELDS]
    problems += [
        (f"t_{f} IS NOT NULL AND {f} IS NULL", f"{f}: not a timestamp")
        for f in _TIMES
    ]
    problems.append(("t_duration_ms IS NOT NULL AND duration_ms IS NULL", "duration_ms: not a number"))
    for f in _COUNTS:
        problems.append((f"{f} IS NULL", f"{f}: not an integer"))
        problems.append((f"{f} < 0 OR {f} > {MAX_TOKENS}", f"{f}: out of range"))
    problems.append(("cost_usd IS NULL", "cost_usd: not a number"))
    # Totals are exact decimals with twenty digits before the point.
    problems.append(("isnan(cost_usd) OR abs(cost_usd) >= 1e20", "cost_usd: out of range"))
    if strict:
        problems.append((f"t_step_type NOT IN {STEP_TYPES}", "step_type: unknown"))
        problems.append((f"t_status NOT IN {STATUSES}", "status: unknown"))
    cases = " ".join(f"WHEN {bad} THEN '{why}'" for bad, why in problems)
    reason = F.expr(f"CASE {cases} END")

    final = {f: F.col(f"t_{f}") for f in _TEXTS}
    decoded = typed.select(
        "value", reason.alias("reason"), *[final.get(c, F.col(c)).alias(c) for c in SPAN_COLUMNS]
    )
    # Besides giving listeners the counts, observing keeps a later filter on
    # ``reason`` from being pushed below the parsing, where the whole parse
    # would be repeated for every condition in it.
    return decoded.observe(
        "span_messages", F.count("*").alias("messages"), F.count("reason").alias("quarantined")
    )


# Fixed formats of numbers in text.
_WHOLE = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _kind(field: str) -> str:
    """JSON type of a field, from a second parse."""

    return f"schema_of_variant(try_variant_get(try_parse_json(value), '$.{field}', 'variant'))"


def _timestamp(field: str) -> Column:
    """A time given as text; a bare number could pass for a basic ISO date."""

    text = F.col(f"t_{field}")
    usual = text.rlike(USUAL_PATTERN)
    return F.when(usual, text.try_cast("timestamp")).when(
        F.expr(f"{_kind(field)} = 'STRING'"), parse_timestamp(text)
    )


def _integer(field: str) -> Column:
    """A count as given: absent is 0, fractions are cut, text must be whole."""

    t = f"t_{field}"
    exact = f"try_cast({t} AS decimal(38,10))"
    plain = f"regexp_replace(trim({t}), '(?<=[0-9])_(?=[0-9])', '')"
    return F.expr(
        f"""CASE
          WHEN {t} RLIKE r'{_WHOLE}' THEN try_cast({t} AS bigint)
          WHEN {t} IS NULL THEN if(array_contains(given, '{field}'), NULL, 0)
          WHEN {_kind(field)} = 'BOOLEAN' THEN if({t} = 'true', 1, 0)
          WHEN {_kind(field)} <> 'STRING' THEN try_cast(if({exact} < 0, ceil({exact}), floor({exact})) AS bigint)
          WHEN {plain} RLIKE r'{_WHOLE}' THEN try_cast({plain} AS bigint) END"""
    )


def _number(field: str) -> Column:
    t = f"t_{field}"
    return F.expr(
        f"""CASE
          WHEN {t} RLIKE r'{_DECIMAL}' THEN try_cast({t} AS double)
          WHEN {t} IS NULL THEN if(array_contains(given, '{field}'), NULL, 0D)
          WHEN trim({t}) RLIKE r'{_DECIMAL}' THEN try_cast(trim({t}) AS double)
          WHEN {_kind(field)} = 'BOOLEAN' THEN if({t} = 'true', 1D, 0D) END"""
    )


def _truth(field: str) -> Column:
    """Whether a flag is set to anything but false, zero, null or empty.

    A quoted "false" is a text that is not empty, hence true.
    """

    t = f"t_{field}"
    return F.expr(
        f"""CASE
          WHEN {t} IS NULL THEN false
          WHEN {t} = 'true' THEN true
          WHEN {t} NOT IN ('', 'false', '[]', '{{}}') AND NOT {t} RLIKE r'^-?[0.]+$' THEN true
          WHEN {t} = '' OR NOT value RLIKE '"{field}"[ ]*:[ ]*"' THEN false
          ELSE {_kind(field)} = 'STRING' END"""
    )


def good_spans(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NULL").select(*SPAN_COLUMNS)


def quarantined(decoded: DataFrame) -> DataFrame:
    """Bad messages as they came, each with its reason."""

    return decoded.where("reason IS NOT NULL").select("value", "reason", "seq", "ingested_at")


def contract_check(spans: DataFrame) -> DataFrame:
    """Spans with the list of contract rules each one breaks (empty when none)."""

    broken = [
        F.when(F.col(f).isNull(), F.lit(f"{f}: missing")) for f in REQUIRED_FIELDS
    ] + [
        F.when(~F.col("step_type").isin(*STEP_TYPES), F.lit("step_type: unknown")),
        F.when(~F.col("status").isin(*STATUSES), F.lit("status: unknown")),
    ]
    return spans.withColumn("violations", F.array_compact(F.array(*broken)))
