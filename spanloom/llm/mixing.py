"""A mix of sources at target weights, by min-cost flow.

Documents may belong to several sources. They are added up by membership
pattern; the driver sees one row per pattern. A flow from patterns to sources
fills the sources' quotas, where the k-th repetition of a pattern's words costs
k - 1: the convex cost takes every document once before any twice. Documents
are then taken in a seeded order until their pattern's share is reached.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import WORD, free_prefix, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 % of all words, as a fraction
MAX_COPIES = 2
SEED = 17
ROWS_A_BIN = 500

_HEX = 8  # hexadecimal digits of the seeded hash that choose a bin


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: dict, weights: dict, share: tuple[int, int] = SHARE, most: int = MAX_COPIES) -> dict:
    """Words each source should give: by weight, but at most ``most`` times its size.

    What a full source leaves is dealt to the others by weight, until none is full.
    """

    times, over = share
    full: set = set()
    while True:
        rest = times * sum(sizes.values()) - over * most * sum(sizes[s] for s in full)
        weight = over * sum(weights[s] for s in sizes if s not in full)
        out = {s: float(most * sizes[s]) if s in full else weights[s] * rest / weight for s in sizes}
        above = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


class _Flow:
    """Successive shortest paths over the small graph of patterns and sources."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: float, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def fill(self, source: int, sink: int, tiny: float) -> None:
        while True:
            best, via, queue = {source: 0}, {}, deque([source])
            while queue:
                u = queue.popleft()
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > tiny and best[u] + self.cost[e] < best.get(v, 1 << 60):
                        best[v], via[v] = best[u] + self.cost[e], e
                        queue.append(v)
            if sink not in via:
                return
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(patterns: dict[tuple, int], wanted: dict, most: int = MAX_COPIES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources, at least repetition."""

    names, kinds = list(wanted), list(patterns)
    flow = _Flow(2 + len(kinds) + len(names))
    where = {s: 2 + len(kinds) + i for i, s in enumerate(names)}
    arcs = {}
    for i, p in enumerate(kinds):
        for k in range(most):
            flow.arc(0, 2 + i, float(patterns[p]), k)
        for s in p:
            arcs[p, s] = flow.arc(2 + i, where[s], float("inf"), 0)
    for s in names:
        flow.arc(where[s], 1, wanted[s], 0)
    flow.fill(0, 1, 1e-9 * (1 + sum(patterns.values())))
    return {p: {s: flow.room[arcs[p, s] ^ 1] for s in p} for p in kinds}


def mix(
    docs: DataFrame,
    membership: Column,
    weights: tuple[int, ...] = WEIGHTS,
    id_column: str = "doc_id",
    text_column: str = "text",
    share: tuple[int, int] = SHARE,
    most: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``sources``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``membership`` is an array of source names; a null name is a source of its
    own, an empty or null array means the null source. Sources sorted by code
    point, null last, get ``weights`` in turn. ``copies`` is how often the mix
    takes a document whole, ``taken`` that many times its words;
    ``source_size`` and ``target`` are sums over its sources. A document without
    words is taken 0 times. Null text counts as empty. Repeated rows count each;
    equal order keys are told apart by id, equal ids by text. An empty table
    gives an empty result. Input columns of the names above are replaced.
    """

    ours = ("sources", "size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in ours]
    own = free_prefix(docs.columns)
    given = F.when(F.size(F.coalesce(membership, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(membership)
    text = text_or_empty(text_column)
    sized = docs.withColumn(f"{own}s", F.array_sort(F.array_distinct(given))).withColumn(f"{own}n", words_in(text)).drop(*ours)
    found = sized.groupBy(f"{own}s").agg(F.sum(f"{own}n").alias("words"), F.count("*").alias("rows")).collect()
    patterns = {tuple(r[0]): r.words for r in found}
    rows = sum(r.rows for r in found)

    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s.encode() if s is not None else b""))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    wanted = targets(sizes, weight, share, most) if names else {}
    flows = route(patterns, wanted, most)

    plan = []
    for p, words in patterns.items():
        takes = sum(flows[p].values())
        whole = min(most, int(takes // words)) if words else 0
        plan.append((list(p), sum(sizes[s] for s in p), sum(wanted[s] for s in p), whole, takes - whole * words))
    spark = docs.sparkSession
    shares = spark.createDataFrame(plan, f"{own}s array<string>, source_size long, target double, {own}whole int, {own}rest double")

    # Running sums in the seeded order: bins of the hash, then rows within a bin.
    bits = min(4 * _HEX, max(0, (rows // ROWS_A_BIN).bit_length()))
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), "utf-8"))
    bin_of = F.shiftright(F.conv(F.substring(f"{own}o", 1, _HEX), 16, 10).cast("long"), 4 * _HEX - bits)
    # The pattern's place in the plan stands for the array: a smaller key.
    slim = F.array_position(F.array(*[_names(p) for p, *_ in plan]), F.col(f"{own}s")) if plan else F.lit(0)
    placed = sized.withColumn(f"{own}p", slim).withColumn(f"{own}o", order).withColumn(f"{own}bin", bin_of)
    bins = placed.groupBy(f"{own}p", f"{own}bin").agg(F.sum(f"{own}n").alias(f"{own}sum"))
    before = Window.partitionBy(f"{own}p").orderBy(f"{own}bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(f"{own}p", f"{own}bin", F.coalesce(F.sum(f"{own}sum").over(before), F.lit(0)).alias(f"{own}before"))
    tie = F.xxhash64(text)
    inside = Window.partitionBy(f"{own}p", f"{own}bin").orderBy(f"{own}o", id_column, f"{own}tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(f"{own}tie", tie).withColumn(f"{own}in", F.coalesce(F.sum(f"{own}n").over(inside), F.lit(0)))
    once_more = 2 * (F.col(f"{own}before") + F.col(f"{own}in")) + F.col(f"{own}n") <= 2 * F.col(f"{own}rest")
    copies = F.when(F.col(f"{own}n") == 0, 0).otherwise(F.least(F.col(f"{own}whole") + once_more.cast("int"), F.lit(most)))
    numbered = shares.withColumn(f"{own}p", slim).drop(f"{own}s")
    return (
        summed.join(bins, [f"{own}p", f"{own}bin"])
        .join(F.broadcast(numbered), f"{own}p")
        .withColumn("copies", copies)
        .select(*kept, F.col(f"{own}s").alias("sources"), F.col(f"{own}n").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col(f"{own}n")).alias("taken"))
    )


def _names(pattern: list) -> Column:
    return F.array(*[F.lit(s).cast("string") for s in pattern])


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of the mix as often as it is taken, with ``columns`` only."""

    again = free_prefix(mixed.columns) + "c"
    return mixed.where("copies > 0").withColumn(again, F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)
