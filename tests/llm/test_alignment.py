"""Token alignment against a literal walk over byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from spanloom.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = list("ab cde  \n\t.,'s'tXYZ0129é ñİßáÅ½²ªº¿ŁƂȺ") + ["<|endoftext|>", "<s>", "</s>", " the", " don't", "  ", "\r\n"]
ODD += ["–", "…", "漢", "🙂", " ", "\u0085", "▁", "\x00", "'ll", "\x1c"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}

    def tokens(text):
        if not text:
            return None
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        return ids_a, np.cumsum(list(map(len, bytes_a))).tolist(), ids_b, np.cumsum(list(map(len, bytes_b))).tolist()

    return tokens


def literal(texts, tokens):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""

    held, linked = [], []
    for text in texts:
        found = tokens(text)
        if found is None:
            held.append(None)
            linked.append([])
            continue
        ids_a, ends_a, ids_b, ends_b = found
        groups = defaultdict(lambda: ([], []))
        shared = sorted(set(ends_a) & set(ends_b))
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, end in zip(ids, ends):
                groups[next(s for s in shared if s >= end)][side].append(i)
        groups = [groups[s] for s in shared]
        held.append((len(ids_a), len(ids_b), groups))
        linked.append([(x, y) for p, q in groups for x in p for y in q])
    count = Counter(pair for links in linked for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for one, links in zip(held, linked):
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups = one
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        n_best = sum(count[pair] == best[pair[0]] for pair in links)
        out.append((n_a, n_b, len(groups), len(links), n_best, sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest()))
    return out


def got(docs, **kwargs):
    return Counter(map(tuple, alignment.align(docs, **kwargs).collect()))


def wanted(rows, tokens):
    return Counter((i, *found) for (i, _), found in zip(rows, literal([t for _, t in rows], tokens)))


def odd_rows(rng, count=150):
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(count)]
    texts += [None, "", " ", "  ", "\n", "a b c", "x" * 1500, "The same text. " * 3, "The same text. " * 3]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id"), rows[3], rows[-1]]


@pytest.mark.parametrize("head", [10**6, 40, 0])
def test_against_walk(docs_of, sides, head):
    rows = odd_rows(random.Random(head))
    docs = docs_of(rows, "row", "pair", "pairs", "times", "n_best", "t").repartition(3)
    assert got(docs, head_pairs=head) == wanted(rows, sides)


def test_exact_tokenizer_alone(docs_of, sides):
    rows = odd_rows(random.Random(9), 40)
    assert got(docs_of(rows), a_ranks=None) == wanted(rows, sides)


def test_word_by_word_or_whole():
    """Ids put together from a chunk's words are the exact tokenizer's."""

    rng = random.Random(11)
    files = alignment.A_FILE, alignment.A_RANKS, alignment.B_FILE
    by_word, plain = alignment.Coder(*files), alignment.Coder(files[0], None, files[2])
    for _ in range(60):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))).encode() for _ in range(20)]
        texts += [" ".join(rng.choice(["the", "don't", "xq1", "Émile,", "12.5", "a\nb"]) for _ in range(9)).encode()]
        for one, two in zip(by_word.ids(texts), plain.ids(texts), strict=True):
            assert (one is None) == (two is None)
            assert one is None or all(map(np.array_equal, one, two))


def test_runs_are_skipped():
    """Ends of one side, of both, and long stretches on a shifted diagonal."""

    rng = np.random.default_rng(1)
    for _ in range(300):
        ends = np.arange(1, 400)
        a = np.union1d(ends[rng.random(399) < rng.choice([0.2, 0.9, 1.0])], [400])
        b = np.union1d(ends[rng.random(399) < rng.choice([0.2, 0.9, 1.0])], [400])
        shared = np.intersect1d(a, b)
        ends_a, ends_b = alignment.shared_ends(a, b)
        assert (a[ends_a - 1] == shared).all() and (b[ends_b - 1] == shared).all()


def test_large_group_costs_its_distinct_ids():
    a, b = np.array([5] * 3000 + [6] * 10), np.array([7] * 2000 + [5, 8])
    pairs, times = alignment.links_of(a, b, np.array([3010]), np.array([2002]), 100)
    assert dict(zip(pairs.tolist(), times.tolist())) == {507: 6_000_000, 505: 3000, 508: 3000, 607: 20_000, 605: 10, 608: 10}


def test_empty(docs_of):
    assert got(docs_of([(1, "a")]).limit(0)) == Counter()
    assert got(docs_of([(1, None), (None, "")])) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (None, 0, 0, 0, 0, 0, 0, ""): 1})


def test_table(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000 OR text IS NULL")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == wanted(rows, sides)
