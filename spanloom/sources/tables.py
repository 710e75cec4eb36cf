"""The span table and the node table, as Parquet folders.

Plain folders (``write_spans``, ``read_spans``) suit batches that are written
once. ``SpanStore`` and the node table keep a manifest, so that streams can
append, and small files be merged, while others read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanloom.operators.dedupe import latest_nodes
from spanloom.schema import NODE_TABLE_COLUMNS, SPAN_COLUMNS, SPAN_SCHEMA, conform
from spanloom.sources.versions import Part, VersionedTable, merge_groups

NODE_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("order_index", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("step_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("orphaned", T.BooleanType()),
        T.StructField("written_at", T.TimestampType()),
    ]
)
_SPAN_FILES = T.StructType([*SPAN_SCHEMA.fields, T.StructField("start_date", T.DateType())])


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Store spans by day, each file a narrow range of runs in time order.

    Range partitioning rather than hashing: a file then holds neighbouring run
    ids, so a lookup by ``trace_id`` skips nearly all row groups by their
    min/max, and a run with very many spans spreads over files instead of
    filling one.
    """

    dated = conform(spans).withColumns(
        {
            "start_date": F.to_date("start_time"),
            "ingested_at": F.coalesce("ingested_at", F.current_timestamp()),
        }
    )
    layout = ["start_date", "trace_id", "start_time", "span_id"]
    (
        dated.repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .write.mode(mode)
        .partitionBy("start_date")
        .parquet(path)
    )


def read_spans(spark: SparkSession, path: str, since=None, until=None, undated: bool = False) -> DataFrame:
    """All stored spans, or those that started on days from ``since`` to ``until``.

    Bounds prune whole days. Spans without a start lie on no day: bounds leave
    them out unless ``undated`` asks for them too. Bounds cut runs at midnight: to
    score runs, use ``read_runs``.
    """

    return _on_days(spark.read.schema(_SPAN_FILES).parquet(path), since, until, undated).select(*SPAN_COLUMNS)


def _on_days(spans: DataFrame, since, until, undated: bool) -> DataFrame:
    none = F.col("start_date").isNull() if undated else F.lit(False)
    if since is not None:
        spans = spans.where(none | (F.col("start_date") >= F.lit(since).cast("date")))
    if until is not None:
        spans = spans.where(none | (F.col("start_date") <= F.lit(until).cast("date")))
    return spans


def read_runs(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """All spans of the runs that have one on days from ``since`` to ``until``.

    The bounds choose runs, not spans: each run comes whole, however long it
    lasts. Its first and last day are read from all days' run ids first, so only
    days between these are read in full.
    """

    return _whole_runs(spark.read.schema(_SPAN_FILES).parquet(path), since, until)


def _whole_runs(stored: DataFrame, since, until) -> DataFrame:
    chosen = _on_days(stored, since, until, False).select("trace_id").distinct()
    # Days on which a chosen run has spans; a run of months between reads its own days only.
    days = stored.select("trace_id", "start_date").where("start_date IS NOT NULL").join(chosen, "trace_id", "left_semi")
    # One row a day of the table at most.
    days = [r.start_date for r in days.select("start_date").distinct().collect()]
    spans = stored.where(F.col("start_date").isNull() | F.col("start_date").isin(days)) if days else stored.limit(0)
    return spans.join(chosen, "trace_id", "left_semi").select(*SPAN_COLUMNS)


_STORED_SPANS = T.StructType(
    [
        *SPAN_SCHEMA.fields,
        T.StructField("value", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("refused", T.BooleanType()),
        T.StructField("start_date", T.DateType()),
    ]
)
TARGET_BYTES = 128 * 1024 * 1024
# Tasks (and files) that a day's spans of one batch are dealt to.
SPREAD = 4


class SpanStore:
    """Good and refused messages by day, under a manifest.

    Batches append small files, dealt by run within a day. ``compact`` merges
    them into files of about ``target_bytes``, each a narrow range of runs in time
    order, so that a point read skips most row groups by their bounds. Readers see
    a version: before or after a merge, never between.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.target_bytes = spark, target_bytes
        self.table = VersionedTable(spark, path, _STORED_SPANS, ("refused", "start_date"), "start_date")

    def append(self, decoded: DataFrame, stream: str | None = None, batch: int = 0) -> int | None:
        """Store what ``messages.decode`` gives, in one write; a batch tried again is not stored twice."""

        refused = F.col("reason").isNotNull()
        rows = decoded.select(
            *[F.when(~refused, F.col(c)).alias(c) if c not in ("seq", "ingested_at") else F.col(c) for c in SPAN_COLUMNS],
            F.when(refused, F.col("value")).alias("value"),
            "reason",
            refused.alias("refused"),
            F.when(~refused, F.to_date("start_time")).alias("start_date"),
        )
        # A hash of the message: refused ones have no run.
        place = F.pmod(F.xxhash64(F.coalesce("trace_id", "value")), F.lit(SPREAD))
        dealt = rows.repartition("refused", "start_date", place).sortWithinPartitions("refused", "start_date", "trace_id", "start_time")
        return self.table.append(dealt, stream, batch)

    def spans(self, since=None, until=None, undated: bool = False, version: int | None = None) -> DataFrame:
        """Good spans, as ``read_spans`` gives them."""

        iso = lambda day: None if day is None else str(day)
        stored = self.table.read(version, iso(since), iso(until)).where("NOT refused")
        return _on_days(stored, since, until, undated).select(*SPAN_COLUMNS)

    def runs(self, since, until, version: int | None = None) -> DataFrame:
        """All spans of the runs that have one on these days, as ``read_runs`` gives them."""

        return _whole_runs(self.table.read(version).where("NOT refused"), since, until)

    def refused(self, version: int | None = None) -> DataFrame:
        """Bad messages as they came, each with its reason."""

        return self.table.read(version).where("refused").select("value", "reason", "seq", "ingested_at")

    def compact(self) -> list[int]:
        """Merge small parts, and those whose days others share; the versions made. Batches may be appended meanwhile."""

        made = []
        for group in merge_groups(self.table.version().parts, self.target_bytes):
            made.append(self.table.replace(group, self._laid_out(group)))
        return made

    def _laid_out(self, group: tuple[Part, ...]) -> DataFrame:
        layout = ["refused", "start_date", "trace_id", "start_time", "span_id"]
        files = max(1, -(-sum(p.bytes for p in group) // self.target_bytes))
        return self.table.read_parts(group).repartitionByRange(files, *layout).sortWithinPartitions(*layout)


def spans_of_run(spans: DataFrame, trace_id: str) -> DataFrame:
    """One run's spans in time order, attributes decoded to a map."""

    return (
        spans.where(F.col("trace_id") == F.lit(trace_id))
        .withColumns(
            {
                "attributes": decoded_attributes(F.col("attributes")),
                "redacted": F.coalesce(F.col("redacted").cast("boolean"), F.lit(False)),
            }
        )
        .orderBy(F.col("start_time").asc_nulls_last(), "seq", "span_id")
    )


def decoded_attributes(attributes):
    """Attribute JSON as a map of texts; empty text is an empty map."""

    text = F.when(attributes == "", F.lit("{}")).otherwise(attributes)
    return F.from_json(text, "map<string,string>")


def node_rows(nodes: DataFrame, written_at=None) -> DataFrame:
    """Assembled nodes as rows of the node table, defaults filled in."""

    stamp = F.current_timestamp() if written_at is None else F.lit(written_at).cast("timestamp")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return nodes.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        F.col("order_index").cast("long").alias("order_index"),
        F.col("depth").cast("int").alias("depth"),
        blank("agent_name"),
        blank("step_type"),
        blank("name"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("ok")).alias("status"),
        "error_message",
        F.coalesce("attributes", F.lit("{}")).alias("attributes"),
        "orphaned",
        stamp.alias("written_at"),
    ).select(*NODE_TABLE_COLUMNS)


def node_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, NODE_SCHEMA)


def ensure_node_table(spark: SparkSession, path: str) -> None:
    """Create the node table unless it exists."""

    table = node_table(spark, path)
    if not table.versions():
        table.commit(lambda now: None if table.versions() else now)


def write_nodes(nodes: DataFrame, path: str, written_at=None, stream: str | None = None, batch: int = 0) -> int | None:
    """Append the given nodes as a version. Readers see the newest row per span.

    A write that fails half-way is in no version. A ``batch`` of a ``stream`` that
    was stored already is not stored again.
    """

    return node_table(nodes.sparkSession, path).append(node_rows(nodes, written_at), stream, batch)


def read_nodes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest row per span, of all that a version (None: the newest) holds."""

    return latest_nodes(node_table(spark, path).read(version))


def compact_nodes(spark: SparkSession, path: str) -> int | None:
    """Swap all parts for the newest rows, run by run. Older versions stay readable until vacuumed."""

    table = node_table(spark, path)
    parts = table.version().parts
    if not parts:
        return None
    layout = ["trace_id", "order_index"]
    newest = latest_nodes(table.read_parts(parts))
    return table.replace(parts, newest.repartitionByRange(*layout).sortWithinPartitions(*layout))
