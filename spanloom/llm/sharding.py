"""Shards of even size with few cut links: balanced label propagation.

Documents with equal texts are linked. Each starts in a shard by its number;
then, round by round, joins tell each document where its linked documents are,
and it moves there as far as the shard's quota of rows allows. A link goes
through the text's hash (a hub) rather than from document to document, so that
a group of copies as large as a third of all rows makes one tally row a shard
and task. Unlinked documents fill the shards up at the end, which makes the
counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import text_or_empty
from spanloom.operators.skew import number_rows
from spanloom.session import Workspace

SHARDS = 24
ROUNDS = 24
FULL = 16  # a shard takes no more rows when less than this part of its room is left
SETTLED = 0.001  # share of linked rows that still move when the rounds end
LAW = "rows"


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(v).cast("double" if isinstance(v, float) else "long") for v in values])


def _wishes(state: DataFrame, full: list[int]) -> DataFrame:
    """``state`` with the shard that each row would move to (its own if none is better)."""

    tally = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    # Ties between shards fall by a hash of hub and shard, so no shard is preferred overall.
    rank = F.struct("n", F.xxhash64("hub", "shard").alias("h"), "shard")
    open_to = ~F.col("shard").isin(full) if full else F.lit(True)
    best = tally.groupBy("hub").agg(
        F.max(F.when(open_to, rank)).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("shard", rank.alias("r")))).alias("all"),  # at most one a shard
    )
    own = F.element_at("all", F.col("shard"))
    size = F.aggregate(F.map_values("all"), F.lit(0).cast("long"), lambda s, r: s + r["n"])
    return state.join(best.withColumn("size", size), "hub").select(
        "pos", "hub", "size", "shard", F.when(F.col("best") > own, F.col("best.shard")).otherwise(F.col("shard")).alias("wish")
    )


def propagate(linked: DataFrame, room: list[int], work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """(pos, hub, shard) after moves towards linked rows, at most about ``room`` rows a shard."""

    shards = len(room)
    held = {r.shard: r["count"] for r in linked.groupBy("shard").count().collect()}
    total = sum(held.values())
    for turn in range(rounds):
        full = [j for j in range(shards) if room[j] - held.get(j, 0) <= room[j] // FULL]
        wishes = work.keep(_wishes(linked, full), f"wishes{turn}")
        # Never more than shards squared rows.
        asked = {(r.shard, r.wish): r["count"] for r in wishes.where("wish != shard").groupBy("shard", "wish").count().collect()}
        into = [sum(n for (_, b), n in asked.items() if b == j) for j in range(shards)]
        out = [sum(n for (a, _), n in asked.items() if a == j) for j in range(shards)]
        # Room counts only what leaves for sure: half of those that ask to leave.
        free = [max(0, room[j] - held.get(j, 0) + out[j] // 2) for j in range(shards)]
        accepted = [min(1.0, free[j] / into[j]) if into[j] else 0.0 for j in range(shards)]
        if sum(into) <= SETTLED * total:
            return linked
        # A small hub goes there whole or not at all. Of a large one the share that fits goes, and
        # since all its rows wish for the same shard, it fills one shard after the other.
        small = F.col("size") * FULL <= max(room)
        of = F.when(small, F.xxhash64("hub", F.lit(turn))).otherwise(F.xxhash64("pos", F.lit(turn)))
        draw = F.pmod(of, F.lit(1 << 20)) / float(1 << 20)
        goes = draw < F.element_at(_numbers(accepted), F.col("wish") + 1)
        moved = wishes.select("pos", "hub", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        linked = work.keep(moved, f"shards{turn}")
        held = {r.shard: r["count"] for r in linked.groupBy("shard").count().collect()}
    return linked


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", work: Workspace | None = None
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot) for each row.

    ``size`` is the text's UTF-8 bytes plus 8; null counts as empty. Row counts
    of shards differ by at most one, slots run from 0 without gaps. Null ids,
    repeated rows and ties are rows like others. An empty table gives none.
    """

    work = work or Workspace(docs.sparkSession, "shards")
    text = text_or_empty(text_column)
    keys = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    )
    order = [F.xxhash64("id", "hub"), F.col("id"), F.col("hub"), F.col("text_crc32"), F.col("size")]
    rows = work.keep(number_rows(keys, order, work, "pos").withColumn("start", F.pmod("pos", F.lit(shards)).cast("int")), "rows")
    room = quotas(rows.count(), shards)

    several = rows.groupBy("hub").count().where("count > 1").select("hub")
    linked = rows.join(several, "hub").select("pos", "hub", F.col("start").alias("shard"))
    linked = propagate(work.keep(linked, "linked"), room, work)

    placed = rows.join(linked.select("pos", "shard"), "pos", "left").select(
        "id", "size", "text_crc32", "hub", "pos",
        F.coalesce("shard", "start").alias("shard"), F.col("shard").isNull().cast("int").alias("_free"),
    )
    held = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    held = [held.get(j, 0) for j in range(shards)]

    # One numbering: linked rows first in each shard, so unlinked ones are surplus first.
    at = number_rows(placed, [F.col(c) for c in ("shard", "_free", "hub", "pos")], work, "seat")
    first = [1 + sum(held[:j]) for j in range(shards)]
    over = [max(0, held[j] - room[j]) for j in range(shards)]
    under = [max(0, room[j] - held[j]) for j in range(shards)]
    slot = F.col("seat") - F.element_at(_numbers(first), F.col("shard") + 1)
    spare = slot - F.element_at(_numbers(room), F.col("shard") + 1)
    index = spare + F.element_at(_numbers([sum(over[:j]) for j in range(shards)]), F.col("shard") + 1)
    # The surplus rows are numbered through; each shard with holes takes the next so many.
    to, hole = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j in reversed(range(shards)):
        before = sum(under[:j])
        to = F.when(F.col("_index") < before + under[j], F.lit(j)).otherwise(to)
        hole = F.when(F.col("_index") < before + under[j], F.col("_index") - before + min(held[j], room[j])).otherwise(hole)
    sent = at.withColumn("_slot", slot).withColumn("_index", F.when(spare >= 0, index))
    return sent.select(
        "id", "size", "text_crc32", F.lit(LAW).alias("law"),
        F.when(F.col("_index").isNull(), F.col("shard")).otherwise(to).cast("int").alias("shard"),
        F.when(F.col("_index").isNull(), F.col("_slot")).otherwise(hole).cast("long").alias("slot"),
    )
