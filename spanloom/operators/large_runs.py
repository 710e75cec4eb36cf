"""Tree assembly for runs too large to gather, shuffled by single spans.

Walking round a forest, entering and leaving each node once, gives a linked
list per run. A node's place in the layout is the number of entries before its
own; its place in the visiting order (siblings reversed) is the number of exits
after its own; its depth is entries minus exits. All three are suffix sums over
the list, found by contraction: in each round the elements whose hash exceeds
that of both neighbours leave the list (a third of all, no two of them next to
each other), and the one before takes over their sums and pointer. When the list
is short it is ranked by pointer doubling, and the elements that left are filled
in, round by round backwards, each from the element it pointed to. A round costs
two thirds of the one before, so all of them together write a few times the input
however deep the trees are. Each element is pointed to by at most one other, hence
the joins have no hot key whatever the tree looks like: one parent with a billion
children, or a chain of a billion, costs the same.

Elements that still point somewhere after enough rounds run in circles: their
component has no root. Only for those, ancestors are walked to find the spans
to promote (see ``assemble``), and the lists are ranked again.

Every round is written to the workspace, which cuts the lineage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.dedupe import last_written_spans
from spanloom.operators.skew import number_rows
from spanloom.session import Workspace

_SUMS = ("entries", "exits")
# Elements of all lists together that pointer doubling ranks without contraction.
SPARSE = 1_000_000


def assemble_large(
    spans: DataFrame, carry: tuple[str, ...], work: Workspace, few: bool
) -> DataFrame:
    """Nodes of ``spans``; ``few`` says whether their runs' ids fit a broadcast."""

    once = last_written_spans(spans, carry)
    keyed = once.select("trace_id", "span_id", "parent_span_id", "start_time", F.coalesce("seq", F.lit(0)).alias("seq"))
    # Positions follow (run, key), so comparing positions compares keys.
    key = [F.col("trace_id"), F.col("start_time").isNull(), F.col("start_time"), F.col("seq"), F.col("span_id")]
    spot = work.keep(number_rows(keyed, key, work).drop("start_time", "seq"), "spots")
    runs = work.keep(spot.groupBy("trace_id").agg(F.count("*").alias("size")), "runs")
    # Doubling must reach across the longest list: two elements per span.
    longest = runs.agg(F.max("size")).first()[0]
    rounds = math.ceil(math.log2(2 * longest)) + 1

    parents = spot.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("pos").alias("parent"))
    linked = work.keep(
        spot.join(parents, ["trace_id", "parent_span_id"], "left").select(
            "trace_id",
            "pos",
            F.coalesce("parent", F.lit(0)).alias("parent"),
            (F.col("parent_span_id").isNotNull() & F.col("parent").isNull()).alias("orphaned"),
        ),
        "linked",
    )

    ranked, circling = _rank(linked, rounds, work)
    layout = visits = ranked
    promoted = None
    if circling:
        promoted = _promoted(linked, ranked, rounds, work)
        moved = promoted.select("pos", F.lit(True).alias("moved"))
        layout, _ = _rank(_cut(linked, moved, work), rounds, work)
        on_cycle = promoted.where("on_cycle").select("pos", F.lit(True).alias("moved"))
        visits, _ = _rank(_cut(linked, on_cycle, work), rounds, work)

    if few:
        runs = F.broadcast(runs)
    placed = (
        spot.join(runs, "trace_id")
        .join(
            layout.where("NOT leaving").select("pos", "entries", (F.col("exits") - F.col("entries")).alias("depth")),
            "pos",
        )
        .join(visits.where("leaving").select("pos", F.col("exits").alias("exits_left")), "pos")
        .join(linked.select("pos", "orphaned"), "pos")
    )
    if promoted is None:
        placed = placed.withColumn("promoted", F.lit(False))
    else:
        marks = promoted.select("pos", F.lit(True).alias("_mark"))
        placed = placed.join(marks, "pos", "left").withColumn(
            "promoted", F.coalesce("_mark", F.lit(False))
        )
    tree = placed.select(
        "trace_id",
        "span_id",
        (F.col("size") - F.col("entries")).alias("order_index"),
        (F.col("exits_left") - 1).alias("visit_index"),
        F.col("depth").cast("int").alias("depth"),
        "orphaned",
        "promoted",
    )
    payload = once.select(
        "trace_id", "span_id", "parent_span_id", "start_time", *[c for c in carry if c != "start_time"]
    )
    return tree.join(payload, ["trace_id", "span_id"]).select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "order_index",
        "visit_index",
        "depth",
        "orphaned",
        "promoted",
        "start_time",
        *[c for c in carry if c != "start_time"],
    )


def _cut(linked: DataFrame, moved: DataFrame, work: Workspace) -> DataFrame:
    """``linked`` with the moved spans made roots."""

    cut = linked.join(moved, "pos", "left").withColumn(
        "parent", F.when(F.col("moved"), F.lit(0)).otherwise(F.col("parent"))
    )
    return work.keep(cut.drop("moved"), "cut")


def _rank(linked: DataFrame, rounds: int, work: Workspace) -> tuple[DataFrame, bool]:
    """Suffix sums over each run's list; and whether some lists have no end.

    Element ids: entering span ``p`` is ``2p``, leaving it is ``2p + 1``.
    """

    # Siblings side by side: their numbers differ by one.
    family = work.keep(
        number_rows(linked.select("trace_id", "parent", "pos"),
                    [F.col("trace_id"), F.col("parent"), F.col("pos")], work, "place"),
        "family",
    )
    after = family.select(
        (F.col("place") - 1).alias("place"),
        F.col("trace_id").alias("_trace"),
        F.col("parent").alias("_parent"),
        F.col("pos").alias("sibling"),
    )
    first = family.where("parent > 0").groupBy(F.col("parent").alias("pos")).agg(F.min("pos").alias("child"))
    same_family = (F.col("_trace") == F.col("trace_id")) & (F.col("_parent") == F.col("parent"))
    chain = (
        family.join(after, "place", "left")
        .withColumn("sibling", F.when(same_family, F.col("sibling")))
        .join(first, "pos", "left")
    )
    entering = F.struct(
        (F.col("pos") * 2).alias("id"),
        F.coalesce(F.col("child") * 2, F.col("pos") * 2 + 1).alias("to"),
        F.lit(1).cast("long").alias("entries"),
        F.lit(0).cast("long").alias("exits"),
    )
    leaving = F.struct(
        (F.col("pos") * 2 + 1).alias("id"),
        F.coalesce(F.col("sibling") * 2, F.when(F.col("parent") > 0, F.col("parent") * 2 + 1)).alias("to"),
        F.lit(0).cast("long").alias("entries"),
        F.lit(1).cast("long").alias("exits"),
    )
    steps = work.keep(chain.select(F.inline(F.array(entering, leaving))), "steps")

    steps = _suffix_sums(steps, rounds, work)
    circling = not steps.where("to IS NOT NULL").isEmpty()
    ranked = steps.select(
        F.floor(F.col("id") / 2).cast("long").alias("pos"),
        (F.col("id") % 2 == 1).alias("leaving"),
        "to",
        *_SUMS,
    )
    return ranked, circling


def _suffix_sums(steps: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """Stored list elements (id, to, entries, exits) with the sums from each to its list's end.

    ``to`` is NULL in the result but where a list has no end.
    """

    rest, left = _contract(steps, work)
    if left:
        rounds = min(rounds, rest.count().bit_length() + 1)
    ranked = _double(rest, rounds, work)
    # Backwards: what an element pointed to when it left is ranked by then.
    for k, gone in reversed(list(enumerate(left))):
        ahead = ranked.select(F.col("id").alias("to"), F.lit(True).alias("found"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
        filled = gone.join(ahead, "to", "left").select(
            "id", F.when(F.col("found"), F.col("_to")).alias("to"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SUMS]
        )
        # Only the new ones are written.
        ranked = ranked.unionByName(work.keep(filled, f"filled{k}"))
    return ranked


def _contract(steps: DataFrame, work: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """The elements that stay, and by round those that left, with their sums and pointers then."""

    count = steps.count()
    if count <= SPARSE:
        return steps, []
    before = steps.where("to IS NOT NULL").select(F.col("to").alias("id"), F.col("id").alias("from"))
    live = work.keep(steps.join(before, "id", "left"), "live0")
    left = []
    while count > SPARSE:
        turn = len(left)
        # A hash and the id: never equal. A list's first element has none before it and stays.
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        leaves = F.col("from").isNotNull() & (rank("id") > rank("from")) & (F.col("to").isNull() | (rank("id") > rank("to")))
        gone = live.where(leaves)
        over = gone.select(F.col("from").alias("id"), F.lit(True).alias("over"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
        back = gone.where("to IS NOT NULL").select(F.col("to").alias("id"), F.col("from").alias("_from"))
        stay = live.where(~leaves).join(over, "id", "left").join(back, "id", "left")
        live = work.keep(
            stay.select(
                "id",
                F.when(F.col("over"), F.col("_to")).otherwise(F.col("to")).alias("to"),
                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SUMS],
                F.coalesce("_from", "from").alias("from"),
            ),
            f"live{turn + 1}",
        )
        now = live.count()
        if now == count:
            break
        count = now
        left.append(gone.drop("from"))
    return live.drop("from"), left


def _double(steps: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """Pointer doubling: every element adopts the sums and the pointer of the one it points to."""

    for _ in range(rounds):
        moving = steps.where("to IS NOT NULL")
        if moving.isEmpty():
            break
        target = steps.select(
            F.col("id").alias("to"),
            F.col("to").alias("_to"),
            *[F.col(c).alias(f"_{c}") for c in _SUMS],
        )
        hopped = moving.join(target, "to").select(
            "id",
            F.col("_to").alias("to"),
            *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in _SUMS],
        )
        done = steps.where("to IS NULL").select("id", "to", *_SUMS)
        steps = work.keep(hopped.unionByName(done), "steps")
    return steps


def _promoted(linked: DataFrame, ranked: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """The spans to promote among those that reach no root.

    All of a component's spans circle together, so parents of these spans are
    among them. Several may share a parent; that join's hot keys are left to
    adaptive skew handling, which can split it because the result is written.
    """

    rootless = ranked.where("to IS NOT NULL AND leaving").select("pos")
    up = work.keep(
        linked.join(rootless, "pos", "left_semi").select(
            "pos", F.col("parent").alias("up"), F.col("parent").alias("low")
        ),
        "up",
    )
    walk = up
    for _ in range(rounds):
        ahead = walk.select(F.col("pos").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        walk = work.keep(
            walk.join(ahead, "up").select(
                "pos", F.col("_up").alias("up"), F.least("low", "_low").alias("low")
            ),
            "walk",
        )
    # After 2**rounds steps the pointer is on the cycle, and ``low`` covers all
    # ancestors. The least position on a cycle is its own ancestor.
    return work.keep(
        walk.where("pos <= low").select("pos", (F.col("pos") == F.col("low")).alias("on_cycle")),
        "promoted",
    )
