"""Continuous ingest: messages to the span store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.redact import redact_json
from spanloom.sources.messages import decode
from spanloom.sources.tables import SpanStore

FLUSH = "2 seconds"
NAME = "ingest"


def start_ingest(
    messages: DataFrame,
    store: SpanStore,
    checkpoint: str,
    flush: str = FLUSH,
    once: bool = False,
    strict: bool = False,
    redact: bool = False,
    compact_every: int | None = None,
    name: str = NAME,
) -> StreamingQuery:
    """Decode a stream of messages and append them, one micro-batch at a time.

    Good and refused messages of a batch go to the store in one write, which
    reads and parses the batch once. The store records the batch under ``name``
    (one for each query and checkpoint), so a batch is stored once however often
    it is tried. Rows are never deduplicated here. ``ingested_at`` is the time at
    which the batch is stored, on Spark's clock: the sender's may be wrong, and a
    run is quiet only when nothing is stored for it any more.

    ``redact`` blanks secrets in attributes before they are stored, and marks the
    spans so. ``compact_every`` merges small files after so many batches; other
    processes may call ``store.compact`` instead. ``once`` drains what there is.
    How much a batch takes is the source's setting (``sources.messages``).
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spans = decode(batch, strict).withColumn("ingested_at", F.current_timestamp())
        if redact:
            spans = spans.withColumns({"attributes": redact_json(F.col("attributes")), "redacted": F.lit(True)})
        store.append(spans, name, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact()

    writer = messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=flush)
    return writer.queryName(f"spanloom-{name}").start()


def without_repeats(spans: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Drop re-sent spans that arrive close together. Off unless asked for: the
    raw table keeps every copy, since totals count copies."""

    return spans.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
