"""Batch scoring: stored spans to trees, findings and metrics."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spanloom.config import Thresholds
from spanloom.operators import detect
from spanloom.operators.assemble import assemble
from spanloom.operators.summary import run_summaries
from spanloom.schema import NODE_PAYLOAD
from spanloom.session import Workspace
from spanloom.sources.tables import write_nodes

log = logging.getLogger("spanloom")


@dataclass(frozen=True)
class Scored:
    """What scoring a set of runs yields."""

    nodes: DataFrame
    summaries: DataFrame
    findings: DataFrame


def score(
    spans: DataFrame,
    limits: Thresholds = Thresholds(),
    trace_id: str | None = None,
    carry: tuple[str, ...] = NODE_PAYLOAD,
    rules: tuple[detect.Rule, ...] = detect.RULES,
    work: Workspace | None = None,
) -> Scored:
    """Assemble, roll up and check all runs in ``spans``, or one of them.

    A run without spans gives empty frames. Trees are read by every rule and
    for the evidence, findings by several consumers: both are stored once, so
    that spans are shuffled and assembled once whatever is asked afterwards.
    """

    if trace_id is not None:
        spans = spans.where(F.col("trace_id") == F.lit(trace_id))
    work = work or Workspace(spans.sparkSession, "score")
    nodes = work.keep(assemble(spans, carry=carry, work=work), "nodes")
    summaries = run_summaries(spans)
    findings = work.keep(detect.find_problems(nodes, summaries, limits, rules), "findings")
    return Scored(nodes, summaries, findings)


def publish(
    scored: Scored,
    node_path: str | None,
    finding_path: str | None,
    batch: int = 0,
    rules=detect.RULES,
    summary_path: str | None = None,
    stream: str | None = None,
) -> None:
    """Store trees, findings and summaries. A failure to store trees is logged,
    not raised: they are for display, and scoring must go on. Findings and
    summaries go to the folder of their batch and replace what an earlier try of
    it left there; trees of a ``stream``'s batch are stored once."""

    if node_path is not None:
        try:
            write_nodes(scored.nodes, node_path, stream=stream, batch=batch)
        except Exception:  # noqa: BLE001
            log.exception("could not store tree nodes in %s", node_path)
    if finding_path is not None:
        _store(detect.finding_documents(scored.nodes, scored.findings, rules), finding_path, batch)
    if summary_path is not None:
        _store(scored.summaries, summary_path, batch)


def _store(rows: DataFrame, path: str, batch: int) -> None:
    (
        rows.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )
