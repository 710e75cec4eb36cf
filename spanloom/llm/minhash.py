"""b-bit MinHash near-duplicates, confirmed on full shingle sets.

One pass over the texts gives each row its shingle set's digest, the minima of
128 hash functions as 32 band keys of four minima, and the lowest four bits of
each minimum, packed into eight longs. Equal sets are one vertex from there on.

Candidates share a band. Their similarity is estimated by counting equal groups
of bits, corrected for the groups that agree by chance; pairs that lie five
standard errors below the threshold go, all others are confirmed on the sets.

Bands may be hot, so pairs come in two steps. First each member of a band meets
its band's centre (the member with the smallest id), and the confirmed pairs are
contracted to classes. Only bands that still hold several classes are left. There
each member outside the band's largest class meets all members of other classes,
in blocks of bounded size that many tasks share, so that no link is lost and no
band's pairs within a class are formed. Shingles that no other set left has bound
from above what two sets can share, which spares the pairs of texts that were
edited too much to be near any other. A pair within 85 % shares no band in about
one of 2 * 10**10 cases.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import chunks
from spanloom.llm.components import components
from spanloom.session import Workspace

SHINGLE = 5  # words
NEAR_PERCENT = 85
MINIMA, BAND = 128, 4
BITS = 4  # kept of each minimum
SLACK = 5  # standard errors of the estimate
BLOCK = 2_048  # members of a band that one task compares with as many others
ROWS_A_GROUP = 100_000
# As measured, so many candidates are sent to every task; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000
SEED = 7

_CHANCE = 2.0**-BITS
_LOW = 0x1111111111111111
_MARKS = "_id long, n long, d1 long, d2 long, th long, bits array<long>, bands array<long>"
_EDGES = "a long, b long"


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets modulo 2**64, one pair for each minimum."""

    drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, MINIMA), np.int64).astype(np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1] * np.uint64(2) + np.uint64(SEED)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; fewer words are one shingle."""

    split = [t.lower().split() for t in texts]  # bytes: only A-Z and the six ASCII spaces
    names = {w: xxhash.xxh64_intdigest(w) for w in set().union(*split)}
    weights = _mixed(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
    sets = []
    for words in split:
        if not words:
            sets.append(np.empty(0, np.uint64))
        elif len(words) < shingle:
            sets.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64))
        else:
            hashes = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
            count = len(words) - shingle + 1
            total = np.zeros(count, np.uint64)
            for k in range(shingle):
                total = _mixed(total + hashes[k : k + count] * weights[k])
            sets.append(np.unique(total))
    return sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per set that is not empty: packed low bits (8 longs) and band keys."""

    ends = np.cumsum([len(s) for s in sets])
    starts, hashes = np.concatenate([[0], ends[:-1]]), np.concatenate(sets)
    factors, offsets = _functions()
    least = np.empty((len(sets), MINIMA), np.uint64)
    for k in range(MINIMA):
        least[:, k] = np.minimum.reduceat(hashes * factors[k] + offsets[k], starts)
    least = _mixed(least)
    a_long = 64 // BITS
    shifts = np.arange(a_long, dtype=np.uint64) * np.uint64(BITS)
    low = (least & np.uint64((1 << BITS) - 1)).reshape(len(sets), -1, a_long)
    packed = np.bitwise_or.reduce(low << shifts, axis=2)
    bands = np.broadcast_to(np.arange(1, MINIMA // BAND + 1, dtype=np.uint64), (len(sets), MINIMA // BAND)).copy()
    for k in range(BAND):
        bands = _mixed(bands + least[:, k::BAND])
    return packed.view(np.int64), bands.view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def _text(docs: DataFrame, text_column: str) -> Column:
    return F.coalesce(F.col(text_column).cast("string"), F.lit(""))


def marks(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """Per row: id, set size, set digest, text hash, packed bits and band keys."""

    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    names = ["_id", "n", "d1", "d2", "th", "bits", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "t"):
                sets = shingle_sets(texts, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                packed, bands = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, p, b in zip(full, *signatures([sets[i] for i in full])):
                        packed[i], bands[i] = p, b
                digests = [_digest(s) for s in sets]
                columns = [batch.column(0)[rows], pa.array([len(s) for s in sets], kinds[1])]
                columns += [pa.array([d[k] for d in digests], kinds[2]) for k in (0, 1)]
                columns += [batch.column(1)[rows], pa.array(packed, kinds[5]), pa.array(bands, kinds[6])]
                yield pa.record_batch(columns, names=names)

    text = _text(docs, text_column)
    given = docs.select(F.col(id_column).cast("long").alias("_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    return given.mapInArrow(run, _MARKS)


def _sets_of(docs: DataFrame, wanted: DataFrame, text_column: str, shingle: int) -> DataFrame:
    """(v, shingles) of the ``wanted`` (v, d1, d2, th): their texts' sets, formed once more."""

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "t"):
                sets = shingle_sets(texts, shingle)
                digests = [_digest(s) for s in sets]
                columns = [pa.array([d[k] for d in digests], kinds[k]) for k in (0, 1)]
                yield pa.record_batch([*columns, pa.array([s.view(np.int64) for s in sets], kinds[2])], names=["d1", "d2", "shingles"])

    text = _text(docs, text_column)
    hashes = wanted.select("th").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("t")).join(hashes, "th", "left_semi").select("t")
    sets = texts.mapInArrow(run, "d1 long, d2 long, shingles array<long>")
    once = sets.groupBy("d1", "d2").agg(F.first("shingles").alias("shingles"))
    return once.join(wanted.select("v", "d1", "d2"), ["d1", "d2"]).select("v", "shingles")


def estimate(a: str, b: str) -> Column:
    """Similarity by counting equal groups of bits, corrected for chance."""

    word = "(x ^ y)"
    folded = " | ".join([word, *(f"shiftrightunsigned({word}, {k})" for k in range(1, BITS))])
    other = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({folded}) & {_LOW}L)), 0, (s, c) -> s + c)")
    return ((1 - other / float(MINIMA)) - _CHANCE) / (1 - _CHANCE)


def least_estimate(percent: int) -> float:
    """``SLACK`` standard errors below the threshold."""

    p = _CHANCE + (1 - _CHANCE) * percent / 100
    return percent / 100 - SLACK * (p * (1 - p) / MINIMA) ** 0.5 / (1 - _CHANCE)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full ``sets`` are near."""

    first = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(first, "a").join(second, "b").where(near).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Sets of very different sizes can't be near."""

    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _shared(sets: DataFrame) -> DataFrame:
    """(v, own): how many shingles of a set another of ``sets`` has too, where not all."""

    alone = sets.select("v", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("v").alias("v"))
    alone = alone.where("c = 1").groupBy("v").agg(F.count("*").alias("alone"))
    return sets.select("v", F.size("shingles").alias("n")).join(alone, "v", "left").select("v", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("own"))


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs across classes within a band that may be near.

    ``members`` are stored rows (band, v, n, own, bits, bands, class); two sets
    share at most the lesser of their ``own``. A pair comes once, from the first of
    the bands that it shares: since its classes differ, all of these are left.
    """

    spark = members.sparkSession
    parts = members.groupBy("band", "class").agg(F.count("*").alias("c"))
    sizes = parts.groupBy("band").agg(F.sum("c").alias("m"), F.max(F.struct("c", "class")).alias("top"))
    sizes = sizes.where("top.c < m")
    across = lambda k: F.expr(f"int(ceil({k} / {BLOCK}))")
    sizes = sizes.select("band", F.col("top.class").alias("top"), across("(m - top.c)").alias("nb"), across("m").alias("na"))
    placed = members.join(sizes, "band").withColumn("h", F.xxhash64("v"))
    i, j = F.pmod("h", "nb").cast("int"), F.pmod("h", "na").cast("int")
    every = F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), j.alias("j")
    few = F.lit(1).alias("side"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("j")
    keep = ["band", "v", "n", "own", "bits", "bands", "class"]
    dealt = placed.select(*keep, *every).unionByName(placed.where(F.col("class") != F.col("top")).select(*keep, *few))
    rows = members.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_GROUP))
    floor = least_estimate(percent)

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        band, v, n, own, label, side, i, j = (table[c].to_numpy() for c in ("band", "v", "n", "own", "class", "side", "i", "j"))
        bits, bands = (table[c].combine_chunks().flatten().to_numpy().reshape(len(v), -1) for c in ("bits", "bands"))
        bits = bits.view(np.uint64)
        order = np.lexsort([side, j, i, band])
        same = (np.diff(band[order]) == 0) & (np.diff(i[order]) == 0) & (np.diff(j[order]) == 0)
        for block in np.split(order, np.flatnonzero(~same) + 1):
            split = int(np.searchsorted(side[block], 1))
            every, few = block[:split], block[split:]
            out_a, out_b = [], []
            for k in few:
                other = label[every] != label[k]
                # Both may be among the few: then one of them asks.
                other &= (v[every] > v[k]) | ~np.isin(v[every], v[few])
                most = np.minimum(own[every], own[k])
                at = every[other & (100 * most >= percent * (n[every] + n[k] - most))]
                x = bits[at] ^ bits[k]
                folded = x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)
                differ = np.bitwise_count(folded & np.uint64(_LOW)).sum(axis=1, dtype=np.int64)
                at = at[((1 - differ / MINIMA) - _CHANCE) / (1 - _CHANCE) >= floor]
                first = (bands[at] == bands[k]).argmax(axis=1)
                at = at[bands[k, first] == band[k]]
                out_a.append(np.full(len(at), v[k]))
                out_b.append(v[at])
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    group = F.pmod(F.xxhash64("band", "i", "j"), F.lit(groups)).alias("part")
    met = dealt.select("*", group).groupBy("part").applyInArrow(compare, _EDGES)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _several(members: DataFrame) -> DataFrame:
    """The members of bands in which more than one class is left."""

    mixed = members.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("band")
    return members.join(mixed, "band")


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    percent: int = NEAR_PERCENT,
    work: Workspace | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Rows are linked when 100 * intersection >= ``percent`` * union of their
    shingle sets. A class is named by the smallest id reachable, the row's own
    included; ``kept`` marks the rows whose id that is. A null text is empty, and
    a text without words is a class of its own row. A null id names a class only
    if no row of it has an id. Repeated rows come back as often as they come.
    Texts of any length count whole. Other input columns play no part; an empty
    table gives an empty result.

    Shingles are compared by 64-bit hashes, sets by 128-bit digests.
    """

    work = work or Workspace(docs.sparkSession, "minhash")
    rows = work.keep(marks(docs, id_column, text_column, shingle), "marks")
    some = rows.where("n > 0")
    once = some.groupBy("d1", "d2").agg(
        F.min("_id").alias("least"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")
    )
    # Written, the numbers stay as they are.
    sets = work.keep(once.withColumn("v", F.monotonically_increasing_id()), "distinct")

    def full_sets(of: DataFrame) -> DataFrame:
        wanted = work.keep(sets.select("v", "d1", "d2", "th").join(of, "v", "left_semi"), "wanted")
        return work.keep(_sets_of(docs, wanted, text_column, shingle), "sets")

    banded = sets.select("v", "n", "least", F.explode("bands").alias("band"))
    rank = F.struct(F.coalesce("least", F.lit((1 << 63) - 1)).alias("i"), "v", "n")
    centres = banded.groupBy("band").agg(F.count("*").alias("m"), F.min(rank).alias("c")).where("m > 1")
    met = banded.join(centres.select("band", "c"), "band").where(F.col("v") != F.col("c.v"))
    met = met.where(_sizes_fit("n", "c.n", percent)).select(F.col("v").alias("a"), F.col("c.v").alias("b")).distinct()
    floor = least_estimate(percent)
    bits = sets.select(F.col("v").alias("a"), F.col("bits").alias("ba"))
    other = sets.select(F.col("v").alias("b"), F.col("bits").alias("bb"))
    met = work.keep(met.join(bits, "a").join(other, "b").where(estimate("ba", "bb") >= floor).select("a", "b"), "pairs")
    ends = met.select(F.col("a").alias("v")).unionByName(met.select(F.col("b").alias("v"))).distinct()
    links = work.keep(confirmed(met, full_sets(ends), percent), "links")
    stars = components(links, work)

    classes = sets.select("v", "n", "bits", "bands").join(stars, F.col("v") == F.col("a"), "left")
    classes = classes.select("v", "n", "bits", "bands", F.coalesce("b", "v").alias("class"))
    members = classes.select("v", "class", F.explode("bands").alias("band"))
    left = work.keep(_several(members), "left")
    shingles = full_sets(left.select("v").distinct())
    may = sets.select("v", "n", "bits", "bands").join(_shared(shingles), "v").where(100 * F.col("own") >= percent * F.col("n"))
    left = work.keep(_several(left.join(may, "v")), "near")
    done = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = work.keep(_cross_pairs(left, percent).join(done, ["a", "b"], "left_anti"), "cross")
    more = work.keep(confirmed(cross, shingles, percent), "more")
    # Stars are links already: what the second step adds joins whole classes.
    stars = components(stars.unionByName(more), work)

    named = sets.select("v", "d1", "d2", "least").join(stars, F.col("v") == F.col("a"), "left")
    named = work.keep(named.select("d1", "d2", "least", F.coalesce("b", "v").alias("class")), "named")
    least = work.keep(named.groupBy("class").agg(F.min("least").alias("component_id")), "least")
    named = work.keep(named.join(least, "class").select("d1", "d2", "component_id"), "classes")
    full = some.select("_id", "n", "d1", "d2").join(named, ["d1", "d2"]).select("_id", "n", "component_id")
    empty = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    found = full.unionByName(empty)
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
