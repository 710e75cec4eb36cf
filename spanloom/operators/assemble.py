"""Rebuild every run's forest from its flat spans, all runs at once.

The result has one row per distinct span: its place in the pre-order layout
(``order_index``), its ``depth``, whether its parent is missing (``orphaned``),
and its place in the order detection visits spans (``visit_index``, children
last to first).

Rules
-----
* A NULL parent makes a root. A parent that is not in the run makes an orphan:
  a root at depth 0 that keeps its subtree.
* Roots and siblings are ordered by ``(start_time nulls last, seq, span_id)``,
  the span's *key*. Rows of a table have no input order, so ``seq`` stands in
  for it.
* Where parents form a cycle, some spans never reach a root. A span of such a
  component is *promoted* to a root exactly when its key is at most the least
  key among its ancestors: spans are tried in key order and each marks its
  descendants, so a span is still unmarked when its turn comes only if no
  ancestor came before. The least key on the cycle always qualifies, so no
  cycle survives.
* Detection walks the raw child lists and skips what it has seen. A promoted
  span off the cycle is then met below its parent first; only the cycle's
  promoted span starts a walk. Hence two parents per span: one for layout, one
  for visiting.

Two ways to the same rows
-------------------------
Nearly all runs are small. They are grouped into one array per run (one shuffle
on ``trace_id``) and solved with array expressions in the JVM; parents become
array positions, so each pointer-doubling round is a linear pass. Array size is
bounded: runs beyond ``MAX_ROWS`` rows or ``MAX_BYTES`` carried bytes are found
first by a partial aggregation and go to ``large_runs``, which shuffles on
single spans and never gathers a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.dedupe import last_written_spans
from spanloom.operators.large_runs import assemble_large
from spanloom.operators.skew import fits_broadcast, keep_or_drop_keys, let
from spanloom.schema import NODE_PAYLOAD, conform
from spanloom.session import Workspace

MAX_ROWS = 2_000
MAX_BYTES = 16 * 1024 * 1024

_DIGITS = 3  # hex digits of a path step; 16**3 exceeds MAX_ROWS
_FEW = 48  # spans, up to which a look through all ids is the fastest
_FAR = 1 << 30  # beyond every array position
_OFF_CYCLE, _ON_CYCLE = 1, 2


def assemble(
    spans: DataFrame,
    carry: tuple[str, ...] = NODE_PAYLOAD,
    trace_id: str | None = None,
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
    work: Workspace | None = None,
) -> DataFrame:
    """Tree nodes of all runs, or of one.

    ``carry`` names the span columns nodes keep; carry fewer to shuffle less.
    Counting run sizes is an action, so this starts a small job when called.
    """

    if max_rows >= 16**_DIGITS:
        raise ValueError(f"max_rows must stay below {16**_DIGITS}")
    spans = conform(spans)
    if trace_id is not None:
        spans = spans.where(F.col("trace_id") == F.lit(trace_id))

    work = work or Workspace(spans.sparkSession, "assemble")
    large = _large_run_ids(spans, carry, max_rows, max_bytes)
    if large.isEmpty():
        return _assemble_small(spans, carry)
    large = work.keep(large, "large")
    fits = fits_broadcast(large, "trace_id")
    small = keep_or_drop_keys(spans, large, fits, "trace_id", keep=False)
    rest = keep_or_drop_keys(spans, large, fits, "trace_id", keep=True)
    return _assemble_small(small, carry).unionByName(assemble_large(rest, carry, work, fits))


def _large_run_ids(spans, carry, max_rows, max_bytes) -> DataFrame:
    types = dict(spans.dtypes)
    texts = [f"coalesce(octet_length({c}), 0)" for c in carry if types[c] == "string"]
    size = " + ".join(["0", *texts])
    return (
        spans.groupBy("trace_id")
        .agg(F.expr("count(*) AS n_rows"), F.expr(f"sum({size}) AS n_bytes"))
        .where(f"n_rows > {max_rows} OR n_bytes > {max_bytes}")
        .select("trace_id")
    )


def _assemble_small(spans: DataFrame, carry) -> DataFrame:
    # Placing rows by run first serves all that follows: a span's copies and a
    # run's spans lie in the same partition already.
    once = last_written_spans(spans.repartition("trace_id"), carry)
    payload = ", ".join(["start_time", *(c for c in carry if c != "start_time")])
    runs = once.groupBy("trace_id").agg(
        F.expr(
            f"""sort_array(collect_list(struct(
                  start_time IS NULL AS undated, start_time AS at, coalesce(seq, 0) AS seq,
                  span_id AS id, parent_span_id AS up, struct({payload}) AS payload))) AS run"""
        )
    )

    # Parents as 1-based positions in the sorted array; 0 for roots and orphans.
    runs = runs.selectExpr(
        "trace_id",
        "run",
        f"if(size(run) <= {_FEW}, {let('ids', 'run.id', _LOOKED_THROUGH)}, {let('known', _BY_ID, _SEARCHED)}) AS parent",
        "int(ceil(log2(size(run) + 1))) AS rounds",
    )
    runs = runs.selectExpr("*", f"{_LIFT} AS lift")
    # For layout every promoted span is a root; for visiting only those that
    # lie on their cycle.
    runs = runs.selectExpr(
        "*",
        f"transform(parent, (p, i) -> if(lift[i] >= {_OFF_CYCLE}, 0, p)) AS layout",
        f"transform(parent, (p, i) -> if(lift[i] >= {_ON_CYCLE}, 0, p)) AS visits",
    )
    runs = runs.selectExpr("*", f"{_paths('layout')} AS path")
    runs = runs.selectExpr(
        "*",
        f"if(array_contains(lift, {_OFF_CYCLE}), {_paths('visits')}, path) AS visit_path",
    )

    # Sorting paths lays the forest out; sorting their digit complements walks
    # it with siblings reversed. A path is a prefix of its descendants' paths,
    # so parents come first either way.
    node = """struct(
        path[i] AS path,
        translate(vp[i], '0123456789abcdef', 'fedcba9876543210') AS visit,
        s.up IS NOT NULL AND parent[i] = 0 AS orphaned,
        lift[i] > 0 AS promoted,
        s AS span)"""
    runs = runs.selectExpr(
        "trace_id",
        let("vp", "visit_path", f"sort_array(transform(run, (s, i) -> {node}))") + " AS laid",
    )
    placed = f"""transform(laid, (n, k) -> struct(
        n.span.id AS span_id,
        n.span.up AS parent_span_id,
        bigint(k) AS order_index,
        bigint(turn[k]) AS visit_index,
        int(length(n.path) / {_DIGITS} - 1) AS depth,
        n.orphaned AS orphaned,
        n.promoted AS promoted,
        n.span.payload AS payload))"""
    flat = runs.selectExpr("trace_id", f"inline({let('turn', _inverse_rank('laid.visit'), placed)})")
    return flat.select("trace_id", *_NODE_PLACE, "payload.*")


_NODE_PLACE = (
    "span_id",
    "parent_span_id",
    "order_index",
    "visit_index",
    "depth",
    "orphaned",
    "promoted",
)

# Parents of few spans are looked through one by one; those of more are searched
# for by halving steps among the ids in order, so that a run costs no square.
_LOOKED_THROUGH = "transform(run, s -> int(coalesce(array_position(ids, s.up), 0)))"
_BY_ID = "array_sort(transform(run, (s, i) -> struct(s.id AS id, i + 1 AS pos)))"
_STEPS = f"array({', '.join(str(1 << k) for k in reversed(range(4 * _DIGITS)))})"
_LAST_UP_TO = f"aggregate({_STEPS}, 0, (at, step) -> if(get(ids, at + step) <= s.up, at + step, at))"
_SEARCHED = let(
    "ids",
    "known.id",
    f"transform(run, s -> {let('at', _LAST_UP_TO, 'if(ids[at] = s.up, int(known[at].pos), 0)')})",
)

# One round of pointer doubling: every span adopts the pointer of the span it
# points to (0 stays 0).
_HOP = "transform(s.up, p -> if(p = 0, 0, s.up[p - 1]))"

# Least ancestor position of every span, and whether its pointer still moves.
_WALKED = f"""aggregate(
    sequence(0, rounds),
    struct(parent AS up, transform(parent, p -> if(p = 0, {_FAR}, p)) AS low),
    (s, r) -> struct(
      {_HOP} AS up,
      transform(s.low, (m, i) -> if(s.up[i] = 0, m, least(m, s.low[s.up[i] - 1]))) AS low))"""

# Per span: 0 not promoted, 1 promoted off its cycle, 2 promoted on it.
# Positions follow keys, so the least ancestor key is the least ancestor
# position; only a span on a cycle is its own ancestor. Where every parent comes
# before its children there is no cycle, and nothing to walk.
_MARKED = f"""transform(w.up, (p, i) -> CASE
    WHEN p = 0 OR i + 1 > w.low[i] THEN 0
    WHEN i + 1 = w.low[i] THEN {_ON_CYCLE}
    ELSE {_OFF_CYCLE} END)"""
_LIFT = f"""if(
    forall(transform(parent, (p, i) -> p <= i), x -> x),
    array_repeat(0, size(parent)),
    {let("w", _WALKED, _MARKED)})"""


def _paths(parent: str) -> str:
    """Per span, the positions from its root down to itself, as fixed-width hex."""

    return f"""aggregate(
        sequence(1, rounds),
        struct({parent} AS up,
               transform({parent}, (p, i) -> lower(lpad(hex(i + 1), {_DIGITS}, '0'))) AS path),
        (s, r) -> struct(
          {_HOP} AS up,
          transform(s.path, (own, i) ->
            if(s.up[i] = 0, own, concat(s.path[s.up[i] - 1], own))) AS path),
        s -> s.path)"""


def _inverse_rank(keys: str) -> str:
    """For each element, its 0-based place when the array is sorted."""

    ordered = f"sort_array(transform({keys}, (x, i) -> struct(x AS x, i AS i)))"
    return f"sort_array(transform({ordered}, (o, place) -> struct(o.i AS i, place AS place))).place"
