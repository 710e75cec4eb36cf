"""Agent-trace analytics on Spark.

Layout
------
``sources``    span messages in, span and node tables, JSON out, span views
``functions``  column expressions: time, cost, redaction, display text
``operators``  tree assembly, run summaries, detection, metrics, reports
``plans``      batch scoring, which strings the operators together
``streaming``  continuous ingest and settle-then-score
"""

from spanloom.config import Settings, Thresholds
from spanloom.operators.assemble import assemble
from spanloom.operators.detect import find_problems
from spanloom.operators.summary import run_summaries

__all__ = ["Settings", "Thresholds", "assemble", "find_problems", "run_summaries"]
