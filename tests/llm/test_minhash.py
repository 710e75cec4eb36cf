"""b-bit MinHash near copies against all pairs of full sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, percent=85):
    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if both and 100 * both >= percent * (len(a) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least.setdefault(find(x), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return Counter((i, len(sets[x]), least[find(x)], i == least[find(x)]) for x, (i, _) in enumerate(rows))


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_texts(rng, groups=12, members=9):
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        texts += [edited(rng, base, rng.randrange(1 + len(base) // 40)) for _ in range(members)]
        texts.append(" ".join(base[: 9 * len(base) // 10]))
    return texts


def got(docs, **kwargs):
    return Counter(map(tuple, minhash.near_copies(docs, **kwargs).collect()))


def test_near_copies(docs_of, odd_texts):
    rng = random.Random(3)
    texts = list(odd_texts) + ["A b C d", "a B c\td", "a b c d e", "A  b c d e f"] + near_texts(rng)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, "no id here at all"), (None, texts[-2]), rows[5], rows[40], (None, None)]
    clashing = ("band", "bands", "v", "class", "th", "n", "bits", "component_id")
    assert got(docs_of(rows, *clashing).repartition(3)) == brute(rows)


def test_no_link_is_lost_in_hot_bands(docs_of, monkeypatch):
    """Members that are near the centre of no band, in blocks far smaller than the band."""

    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    # Chains: each text changes one place more, so far ends are not near; the smallest id is a far end.
    chain, rows = list(base), []
    for i in range(60):
        chain[(i * 7) % 200] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(100 + i, edited(rng, base, 9)) for i in range(60)]
    assert got(docs_of(rows)) == brute(rows)


@pytest.mark.parametrize("near", [0.5, 0.85, 0.95])
def test_estimate(spark, near):
    """Bit counts corrected for chance agree with the similarity of the sets."""

    rng = np.random.default_rng(5)
    size, found = 2_000, []
    shared = round(2 * size * near / (1 + near))
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 2 * size, np.int64).astype(np.uint64)
        a, b = pool[:size], np.concatenate([pool[:shared], pool[size : 2 * size - shared]])
        bits, _ = minhash.signatures([np.sort(a), np.sort(b)])
        found.append((bits[0].tolist(), bits[1].tolist()))
    got = [r.e for r in spark.createDataFrame(found, "a array<long>, b array<long>").select(minhash.estimate("a", "b").alias("e")).collect()]
    assert abs(np.mean(got) - near) < 0.02
    assert min(got) >= minhash.least_estimate(round(100 * near))


def test_empty(docs_of):
    assert got(docs_of([(1, "a")]).limit(0)) == Counter()
    assert got(docs_of([(1, None), (2, ""), (None, " ")])) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (None, 0, None, True): 1})


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
