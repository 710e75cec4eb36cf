"""Repeated passages by prefix doubling over names of positions.

A byte goes if it lies in a 50-byte string that also starts in a document with a
smaller id. Prefix doubling names equal strings at growing lengths and keeps on
only with positions whose name occurs again:

1. Within a task, names of 1, 2, 4, 8, 16 and 24 bytes: each from a pair of
   names at a growing offset. A name is a 64-bit hash, not a dense rank, so no
   sort is needed to make it and equal strings have equal names in every task.
2. Of each window of 50 bytes only the 24-byte string with the least name goes
   on (it is the same one wherever the window occurs). It serves all windows
   that share it: a run of windows. A shuffle finds the names that occur in
   several documents; positions whose name is unique leave here.
3. Runs that remain are named as a whole and ranked by name: the least document
   of each (run) name is the first to have it, and every other one is a repeat.
4. Where one 24-byte name has several runs, their windows differ at some offset
   from it. Each window holds the name with 13 more bytes before or behind it:
   such halves of a run are ranked first, and windows of a half that no other
   document has are unique and leave here.
5. The windows left are named one by one at 50 bytes, past which nothing needs
   to be told apart, and ranked alike.

Names of a run, half or window are joined with the 24-byte name (48 bits), so
about 112 bits must agree by chance for a wrong match; a run has 76 bytes at most.

Hot passages stay cheap: a task sends each name once, flagged if several of its
documents have it, and ranks are minima with map-side aggregation. Texts are
stored once in the shared folder, bucketed by id; later steps join small tables
to them without moving texts again.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import joined
from spanloom.session import Workspace

LENGTH = 50
NAME = 24  # bytes of the names that are ranked first
MORE = (LENGTH - NAME) // 2  # bytes before or behind a name in a half
BLOCK = 1 << 14  # positions named at once, so that the arrays stay in a core's cache
CHUNK = 1 << 20  # bytes of text handled at once: a task's arrays take about a hundred times that
SENT = 2 << 20  # the same where a chunk's names are sent; a larger one sends fewer names twice
BUCKET = 8 << 20  # bytes of text a group of names stands for
LEAST_BUCKETS = 32
LAST_ID = (1 << 63) - 1

_rng = np.random.default_rng(41)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PAIR = _rng.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHORT = np.uint64(16)  # 48 bits of a name, then the document's number in its chunk
_MANY = 0xFFFF  # instead of that number: several documents of the chunk


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _names(data: np.ndarray) -> np.ndarray:
    """Names of all ``NAME``-byte strings, by doubling: 1, 2, 4, 8, 16, then 16 + 8."""

    name, width, kept = _BYTE[data], 1, None
    for level in range(4):
        name = name[:-width] * _PAIR[level] + name[width:]
        width *= 2
        kept = name if width == 8 else kept
    rest = kept[16:]
    return _mix(name[: len(rest)] * _PAIR[4] + rest)


def _least(name: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring names."""

    least, held = name, 1
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    rest = width - held
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, ends, and for each run of windows: text, first and last window, 48-bit name."""

    return _runs(*joined(texts))


def _runs(data: np.ndarray, ends: np.ndarray, each: np.ndarray | None = None) -> tuple:
    """``runs`` of joined texts; ``each`` gets the names of all positions."""

    n = len(data) - LENGTH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return data, ends, none, none, none, np.empty(0, np.uint64)
    least, begins = np.empty(n, np.uint64), np.ones(n, bool)
    for at in range(0, n, BLOCK):
        # The window before the block is named again, to compare with.
        back, to = max(at - 1, 0), min(at + BLOCK, n)
        name = _names(data[back : to + LENGTH - 1])
        if each is not None:
            each[back : back + len(name)] = name
        held = _least(name, LENGTH - NAME + 1)
        least[back:to] = held
        begins[back + 1 : to] = (held[1:] != held[:-1]) | (name[: len(held) - 1] == held[:-1])
    # Windows across the end of a text are none; the next text's first one begins a run.
    starts = ends[:-1]
    begins[starts[starts < n]] = True
    for end in ends[1:].tolist():
        begins[max(end - LENGTH + 1, 0) : end] = False
    first = np.flatnonzero(begins)
    owner = np.searchsorted(ends, first, side="right") - 1
    # A run ends before the next one, or with the last window inside its text.
    last = np.minimum(np.append(first[1:], n) - 1, ends[owner + 1] - LENGTH)
    return data, ends, owner, first, last, least[first] >> _SHORT


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base from 0 to ``count``, and of its inverse."""

    up, down = np.full(count + 1, _BASE), np.full(count + 1, _BACK)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_usual_powers = functools.cache(_powers)


class Spans:
    """64-bit names of any spans of one array of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        # Powers for a chunk are kept; those for a larger text only as long as it.
        powers, self.back = _usual_powers(2 * CHUNK) if len(data) <= 2 * CHUNK else _powers(len(data))
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = held = np.uint64(0)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            sums = self.prefix[at + 1 : at + 1 + len(block)]
            np.cumsum(_BYTE[block] * powers[at : at + len(block)], out=sums)
            sums += held
            held = sums[-1]

    def names(self, begin: np.ndarray, end: np.ndarray, with_name: np.ndarray) -> np.ndarray:
        whole = (self.prefix[end] - self.prefix[begin]) * self.back[begin]
        return _mix(whole + (end - begin).astype(np.uint64) * _PAIR[5] + with_name * _PAIR[6])


def _parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of bounded size, with the texts."""

    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]
        first, held = 0, 0
        for i, text in enumerate(texts):
            if i > first and (held + len(text) > limit or i - first >= _MANY - 1):
                yield batch.slice(first, i - first), texts[first:i]
                first, held = i, 0
            held += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; a null list is empty."""

    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _among(keys: np.ndarray, rows: np.ndarray, held: np.ndarray, held_rows: np.ndarray) -> np.ndarray:
    """Whether each key is among those held by its row."""

    if not len(held):
        return np.zeros(len(keys), bool)
    salt = _mix(np.arange(1, 1 + max(rows.max(initial=0), held_rows.max(initial=0)) + 1, dtype=np.uint64))
    known, asked = np.sort(held.view(np.uint64) ^ salt[held_rows]), keys ^ salt[rows]
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's names, each once, by bucket; and names that the chunk itself has twice."""

        for part, texts in _parts(batches, "text", SENT):
            ids = part.column(0).to_numpy()
            _, _, owner, _, _, name = runs(texts)
            if not len(name):
                continue
            entry = np.sort((name << _SHORT) | owner.astype(np.uint64))
            entry = entry[np.append(True, entry[1:] != entry[:-1])]
            name = entry >> _SHORT
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            several = np.diff(np.append(start, len(name))) > 1
            sent = entry[start]
            sent[several] |= np.uint64(_MANY)
            known = np.repeat(several, np.diff(np.append(start, len(name))))
            group = ((sent >> _SHORT) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            sent, group = sent[order], group[order]
            cuts = np.flatnonzero(np.diff(group)) + 1
            rows = [(int(g[0]), b) for g, b in zip(np.split(group, cuts), np.split(sent, cuts))]
            if known.any():
                rows.append((-1, entry[known]))
            blocks, documents = [], []
            for _, block in rows:
                # Only the documents that the block names, numbered anew.
                number = (block & np.uint64(_MANY)).astype(np.int64)
                used, place = np.unique(number, return_inverse=True)
                used_ids = np.where(used == _MANY, 0, ids[np.minimum(used, len(ids) - 1)])
                place = np.where(number == _MANY, _MANY, place).astype(np.uint64)
                blocks.append(((block >> _SHORT << _SHORT) | place).tobytes())
                documents.append(used_ids.astype("<i8").tobytes())
            salt = int(entry[0] >> np.uint64(20)) % buckets  # chunks' own finds go anywhere
            keys = [g if g >= 0 else buckets + salt for g, _ in rows]
            columns = [pa.array(keys, pa.int64()), pa.array(blocks, pa.binary()), pa.array(documents, pa.binary())]
            yield pa.record_batch(columns, names=["bucket", "block", "ids"])

    return run


def _meet(buckets: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, names): the names of each document that other documents have too."""

        entries, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            for block, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                entry, known = np.frombuffer(block, np.uint64), np.frombuffer(ids, "<i8")
                number = (entry & np.uint64(_MANY)).astype(np.int64)
                entries.append(entry)
                owners.append(np.where(number == _MANY, 0, known[np.minimum(number, len(known) - 1)]))
        entry, owner = np.concatenate(entries), np.concatenate(owners)
        name, flagged = entry >> _SHORT, (entry & np.uint64(_MANY)) == _MANY
        if key[0].as_py() < buckets:
            _, group, count = np.unique(name, return_inverse=True, return_counts=True)
            again = (count > 1)[group] & ~flagged  # a flagged name that is alone has been told
            name, owner = name[again], owner[again]
        order = np.argsort(owner, kind="stable")
        name, owner = name[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        offsets = pa.array(np.append(start, len(owner)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(name.view(np.int64)))
        yield pa.record_batch([pa.array(owner[start]), lists], names=["doc", "names"])

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, run, doc) of the runs whose name is among their document's repeated names."""

    for part, texts in _parts(batches, "text"):
        data, _, owner, first, last, name = runs(texts)
        keep = _among(name, owner, *_flat(part.column(2)))
        owner, first, last, name = (x[keep] for x in (owner, first, last, name))
        run = Spans(data).names(first, last + LENGTH, name)
        columns = [name.view(np.int64), run.view(np.int64), part.column(0).to_numpy()[owner]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["name", "run", "doc"])


def _asked(part: pa.RecordBatch, texts: list[bytes], column: int) -> tuple:
    """spans, and the runs that the document is asked for: text, first and last window, name, place of the name."""

    data, ends = joined(texts)
    each = np.empty(max(len(data) - NAME + 1, 0), np.uint64)
    _, _, owner, first, last, name = _runs(data, ends, each)
    spans = Spans(data)
    keep = _among(spans.names(first, last + LENGTH, name), owner, *_flat(part.column(column)))
    owner, first, last, name = (x[keep] for x in (owner, first, last, name))
    # The name begins where the run ends, or behind it if a smaller one or the text's end cut the run.
    place, open_ = last.copy(), np.arange(len(first))
    for _ in range(LENGTH - NAME + 1):
        open_ = open_[each[place[open_]] >> _SHORT != name[open_]] if len(open_) else open_
        place[open_] += 1
    return spans, owner, first, last, name, place


def _halves_of(spans: Spans, first: np.ndarray, last: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple:
    """Names of the halves of each run, with the name at their end and start, and whether a window holds them.

    Windows from ``place - MORE`` on hold the latter, earlier ones the former.
    """

    before, behind = first < place - MORE, last >= place - MORE
    # Halves that no window holds may leave the text; they get a place inside, and no use.
    a, b = np.where(before, place - MORE, place), np.where(behind, place + NAME + MORE, place + NAME)
    former = spans.names(a, place + NAME, name + np.uint64(1 << 48))
    return former, spans.names(place, b, name), before, behind


def _once(part: pa.RecordBatch, key: np.ndarray, owner: np.ndarray, column: str) -> pa.RecordBatch:
    """(key, doc), each once a text."""

    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    columns = [key[new].view(np.int64), part.column(0).to_numpy()[owner[new]]]
    return pa.record_batch([pa.array(c) for c in columns], names=[column, "doc"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, doc) of the halves of the runs that the document is asked for, each once a text."""

    for part, texts in _parts(batches, "text"):
        spans, owner, *run = _asked(part, texts, 2)
        former, latter, before, behind = _halves_of(spans, *run)
        half, owner = np.append(former[before], latter[behind]), np.append(owner[before], owner[behind])
        yield _once(part, half, owner, "half")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc) of the windows in shared halves of the runs that the document is asked for, each once a text."""

    for part, texts in _parts(batches, "text"):
        spans, owner, first, last, name, place = _asked(part, texts, 2)
        former, latter, before, behind = _halves_of(spans, first, last, name, place)
        shared = _flat(part.column(3))
        before &= _among(former, owner, *shared)
        behind &= _among(latter, owner, *shared)
        middle = place - MORE
        first, last = np.where(before, first, np.maximum(first, middle)), np.where(behind, last, np.minimum(last, middle - 1))
        some = before | behind
        first, last, owner, name = (x[some] for x in (first, last, owner, name))
        count = last - first + 1
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else first
        name, owner = np.repeat(name, count), np.repeat(owner, count)
        yield _once(part, spans.names(at, at + LENGTH, name), owner, "window")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its removed spans (bytes, end exclusive) and what is left."""

    for part, texts in _parts(batches, "text"):
        data, ends, owner, first, last, name = runs(texts)
        spans = Spans(data)
        key = spans.names(first, last + LENGTH, name)
        repeated = _among(name, owner, *_flat(part.column(2)))
        new = _among(key, owner, *_flat(part.column(3)))
        edge = np.zeros(len(data) + 1, np.int64)
        gone = repeated & ~new
        np.add.at(edge, first[gone], 1)
        np.add.at(edge, last[gone] + LENGTH, -1)
        # Windows that are repeats although their run is new.
        lists, rows = _flat(part.column(4))
        if len(lists):
            some = np.isin(owner, np.unique(rows)) & repeated & new
            f, l, o, m = first[some], last[some], owner[some], name[some]
            count = l - f + 1
            at = np.repeat(f - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else f
            hit = _among(spans.names(at, at + LENGTH, np.repeat(m, count)), np.repeat(o, count), lists, rows)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out_spans, left = [], []
        for i in range(len(texts)):
            a, b = ends[i], ends[i + 1]
            here = covered[a:b]
            if here.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                out_spans.append([{"s": int(s), "e": int(e)} for s, e in zip(turn[::2], turn[1::2])])
                left.append(data[a:b][~here].tobytes())
            else:
                out_spans.append([])
                left.append(texts[i])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        columns = [part.column(1), pa.array(np.diff(ends)), pa.array(out_spans, kind), pa.array(left, pa.binary())]
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in left]))
        yield pa.record_batch(columns, names=["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])


def _listed(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("doc").agg(F.collect_list(column).alias(column))


def _several(rows: DataFrame, column: str) -> DataFrame:
    """The names that several documents have, with the least of these."""

    found = rows.groupBy(column).agg(F.min("doc").alias("least"), F.max("doc").alias("greatest"))
    return found.where("greatest > least").select(column, "least")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, kept_sha256) for each row.

    ``spans`` are the removed stretches of the row's UTF-8 bytes, in order and
    apart; ``kept`` are the bytes left, concatenated (they may break a
    character). A null text counts as empty. Rows of one id do not count as
    repeats of each other; null ids come last and are one id. Texts of under 50
    bytes lose nothing. Other columns play no part. An empty table gives none.
    """

    spark = docs.sparkSession
    work = work or Workspace(spark, "repeats")
    given = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.encode(F.coalesce(F.col(text_column).cast("string"), F.lit("")), "utf-8").alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"spanloom_repeats_{uuid.uuid4().hex}"
    given.repartition(parts, "doc").write.option("path", f"{work.root}/texts").bucketBy(parts, "doc").saveAsTable(table)
    stored = spark.table(table)

    size = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    sent = stored.select("doc", "text").mapInArrow(_send(buckets), "bucket long, block binary, ids binary")
    met = sent.groupBy("bucket").applyInArrow(_meet(buckets), "doc long, names array<long>")
    names = work.keep(met.groupBy("doc").agg(F.flatten(F.collect_list("names")).alias("names")), "names")

    with_names = stored.select("doc", "text").join(names, "doc").select("doc", "text", "names")
    ranked = with_names.mapInArrow(_rank, "name long, run long, doc long")
    firsts = work.keep(ranked.groupBy("name", "run").agg(F.min("doc").alias("doc")), "runs")
    several = firsts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    asked = _listed(firsts.join(several, "name").select("doc", "run"), "run")
    texts = stored.select("doc", "text").join(work.keep(asked, "asked"), "doc").select("doc", "text", "run")
    halves = work.keep(texts.mapInArrow(_halves, "half long, doc long"), "halves")
    shared = _listed(halves.join(_several(halves, "half"), "half").select("doc", "half"), "half")
    windows = texts.join(shared, "doc").select("doc", "text", "run", "half")
    named = work.keep(windows.mapInArrow(_windows, "window long, doc long"), "windows")
    later = named.join(_several(named, "window"), "window").where("doc > least").select("doc", "window")

    whole = (
        stored.join(names, "doc", "left")
        .join(_listed(firsts.select("doc", "run"), "run"), "doc", "left")
        .join(_listed(later, "window"), "doc", "left")
        .select("doc", "doc_id", "names", "run", "window", "text")
    )
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary, kept_sha256 string")

