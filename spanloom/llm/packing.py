"""Cost-balanced packing of whole documents into training sequences.

Documents become token ids plus an end id, cut into pieces of at most one
sequence. Pieces are dealt by hash into groups of bounded size. Within a group
there are just enough sequences for its tokens; pieces, longest first, go to
the sequence of lowest estimated attention cost (linear plus quadratic in the
piece's length) that still has room for them. A piece that fits nowhere whole
is cut, so only a group's last few tokens of room stay empty.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import byte_symbols, chunks

CAPACITY = 4096
END_ID = 2
ROWS_A_GROUP = 4096
# A token's cost is 1 plus this for each token of its piece that it attends to.
QUADRATIC = 1 / 4096
LONG_WORD = 1_000  # code points; beyond, only the tokenizer's own merging stays fast
CHUNK_BYTES = 6 << 20  # text whose distinct words are encoded once

_ODD = re.compile("[\0\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")  # beyond Latin-1, or white space to some readers only
_END = "\0"  # stands for the end of a piece
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
_OUT = _PIECE + ", sequence_id long, offset long"


class Encoder:
    """Token ids as little-endian bytes, from the distinct words of a chunk of texts.

    Holds for tokenizers that drop white space and never join across it, such as
    ``word_bpe_49k.json``; a text is the ids of its words, one after the other.

    Texts in Latin-1 are lower-cased as their tokenizer does, cut into its pieces,
    and merged by a faster library from the same vocabulary, each piece with a mark
    at its end. Other texts, and those in which lower-casing could make a special
    token, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as lines:
            self.fast = self._merger(json.load(lines))

    def _merger(self, held: dict):
        """The vocabulary by rank, or None where ids don't rise with the merges."""

        import tiktoken

        symbols = byte_symbols()
        vocabulary, special = held["model"]["vocab"], {x["content"] for x in held["added_tokens"]}
        ranks: dict[bytes, int] = {}
        for entry, rank in vocabulary.items():
            if entry not in special:
                plain = entry.removesuffix("</w>")
                ranks[bytes(symbols[c] for c in plain) + (b"" if plain == entry else _END.encode())] = rank
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        pattern = next((x["pattern"]["Regex"] for x in held["pre_tokenizer"].get("pretokenizers", ()) if x["type"] == "Split"), None)
        rises = made == sorted(made) and len(ranks) == len(vocabulary) - len(special & vocabulary.keys())
        if not (rises and pattern and made[0] >= 512 and held["model"]["end_of_word_suffix"] == "</w>"):
            return None
        self.piece = regex.compile(pattern)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, rank in ranks.items():
            self.length[rank] = len(entry)
        return tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _ask(self, words: list[str]) -> dict[str, bytes]:
        """Ids of ``words`` from the tokenizer."""

        found = {}
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            for word, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                found[word] = np.array(code.ids, "<u4").tobytes()
        return found

    def _merge(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct Latin-1 words in lower case."""

        cut = self.piece.findall
        marked = [w + _END if w.isalpha() else "".join([x + _END for x in cut(w)]) for w in words.to_pylist()]
        ends = np.cumsum(pc.binary_length(pa.array(marked, pa.string())).to_numpy())
        parts = ["".join(marked[at : at + 4096]) for at in range(0, len(marked), 4096)]
        ids = np.concatenate([self.fast.encode_to_numpy(x, disallowed_special=()) for x in parts]).astype(np.int32)
        # A word's ids end where its bytes end; one without pieces has none.
        cuts = np.searchsorted(np.cumsum(self.length[ids]), ends, side="right")
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pa.array(ids))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        decoded = [raw.decode() for raw in texts]
        plain = []
        if self.fast is not None:
            usual = (i for i, t in enumerate(decoded) if _ODD.search(t) is None and "<|" not in t)
            plain = [i for i in usual if len(decoded[i]) < LONG_WORD or max(map(len, decoded[i].split()), default=0) < LONG_WORD]
        if plain:
            split = pc.ascii_split_whitespace(pa.array([decoded[i].lower() for i in plain], pa.string()))
            coded = split.flatten().dictionary_encode()
            if len(coded):
                taken = self._merge(coded.dictionary).take(coded.indices)
                ids, ends = taken.values.to_numpy(), taken.offsets.to_numpy()[split.offsets.to_numpy()]
                for k, i in enumerate(plain):
                    out[i] = ids[ends[k] : ends[k + 1]].tobytes()
        rest = {i: [w for w in re.split("[ \t\n\r]+", decoded[i]) if w] for i in set(range(len(texts))).difference(plain)}
        known = self._ask(list(set().union(*rest.values())))
        for i, words in rest.items():
            out[i] = b"".join(map(known.__getitem__, words))
        return out


@functools.cache
def encoder(name: str) -> Encoder:
    """One a Python worker. ``name`` is looked up on the machine that runs the task."""

    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if os.path.isabs(name):
        return Encoder(name)
    import public_tokenizers

    return Encoder(public_tokenizers.path(name))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): token ids in pieces of at most ``capacity``."""

    width = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for rows, texts in chunks(batch, "t", CHUNK_BYTES):
                out: tuple[list, ...] = ([], [], [], [], [])
                for key, ids in zip(batch.column(0)[rows].to_pylist(), coder.encode(texts)):
                    ids += end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        for column, value in zip(out, (key, at // 4, len(piece) // 4, piece, len(ids) // 4)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                names = ["doc_id", "start", "length", "ids", "doc_tokens"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return given.mapInArrow(run, _PIECE)


def assign(lengths: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, first token, tokens, sequence, offset) for each part of each piece.

    ``lengths`` must fall. Whole pieces go to the cheapest sequence with room;
    one that has room nowhere is cut over those with most room.
    """

    total = int(lengths.sum())
    count = -(-total // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    done = []

    def put(piece: int, first: int, tokens: int, at: int) -> None:
        done.append((piece, first, tokens, at, capacity - int(room[at])))
        room[at] -= tokens
        cost[at] += tokens + quadratic * tokens * tokens

    for piece, length in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[at] >= length:
            put(piece, 0, length, at)
            continue
        first = 0
        while first < length:
            at = int(np.argmax(room))
            tokens = min(int(room[at]), length - first)
            put(piece, first, tokens, at)
            first += tokens
    return done


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_a_group: int = ROWS_A_GROUP,
) -> DataFrame:
    """One row for each piece, with its ``ids`` (little-endian 32-bit) and its place.

    Columns: doc_id, start, length, ids, doc_tokens, sequence_id, offset. Each
    id of each row lies in exactly one piece. A null or empty text is its end id
    alone. Repeated rows are packed each; null ids stay null. Input columns
    besides id and text play no part. An empty table gives an empty result. A
    text of any length is cut into pieces; a group holds about ``rows_a_group``
    rows, or as many full sequences at most.
    """

    # A token has a byte at least.
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text_column).cast("string"))).alias("bytes")).first()
    groups = max(1, -(-size.rows // rows_a_group), -(-(size.bytes or 0) // (rows_a_group * capacity)))
    cut = pieces(docs, tokenizer, capacity, id_column, text_column)
    grouped = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        ids = table["ids"].to_pylist()
        docs_, starts, whole = (table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        base = key[0].as_py() << 32
        done = assign(table["length"].to_numpy(), capacity)
        for at in range(0, len(done), 2048):
            part = done[at : at + 2048]
            columns = [
                pa.array([docs_[p] for p, *_ in part], pa.int64()),
                pa.array([starts[p] + f for p, f, *_ in part], pa.int64()),
                pa.array([n for _, _, n, _, _ in part], pa.int64()),
                pa.array([ids[p][4 * f : 4 * (f + n)] for p, f, n, _, _ in part], pa.binary()),
                pa.array([whole[p] for p, *_ in part], pa.int64()),
                pa.array([base + s for _, _, _, s, _ in part], pa.int64()),
                pa.array([o for *_, o in part], pa.int64()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return grouped.groupBy("group").applyInArrow(run, _OUT)
