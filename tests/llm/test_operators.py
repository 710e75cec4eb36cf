"""Each operator against brute force on small tables, with the odd cases of its contract."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from compare import difference, tables
from pyspark.sql import functions as F
from spanloom.llm import exact_dedup, mixing, packing, pii, quality, secrets, sharding, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_with_ids(texts):
    """Ids out of order, one null id, one row twice."""

    rows = [(100 - i, t) for i, t in enumerate(texts)]
    return rows + [(None, "null id text"), rows[5]]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql() and n not in entry.QUERIES])
def test_against_sql(spark, name):
    said = difference(spark, tables(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert said is None, said


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


# Packing


def check_pieces(rows, texts):
    """Pieces partition each document's ids; sequences are gapless and within capacity."""

    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_text, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_text[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_text[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    used = sum(n for pieces in by_sequence.values() for _, n in pieces)
    return 1 - used / packing.CAPACITY / max(len(by_sequence), 1)


def test_packing(docs_of, odd_texts, sample):
    texts = {i: t for i, t in enumerate(odd_texts)}
    check_pieces(packing.pack(docs_of(list(texts.items()), "ids", "start", "group")).collect(), texts)
    real = {r.doc_id: r.text for r in sample.collect()}
    assert check_pieces(packing.pack(sample, rows_a_group=40).collect(), real) < 0.2
    twice = packing.pack(docs_of([(1, "same words"), (1, "same words"), (None, "x")])).collect()
    assert sorted((r.doc_id is None, r.length) for r in twice) == sorted([(False, 3), (False, 3), (True, 2)])
    assert packing.pack(docs_of([])).count() == 0


def test_assignment_balances_cost():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 1500, 900))[::-1]
    done = packing.assign(lengths, 4096)
    cost = Counter()
    for _, _, n, at, _ in done:
        cost[at] += n + packing.QUADRATIC * n * n
    assert max(cost.values()) < 1.15 * np.mean(list(cost.values()))
    assert sum(n for _, _, n, _, _ in done) == lengths.sum()


# Repeated passages


def removed(rows):
    """Literal: cover each byte of a 50-byte string that a smaller id has."""

    held = sorted(((k if k is not None else 1 << 63), (t or "").encode()) for k, t in rows)
    seen, out = set(), []
    for _, group in itertools.groupby(held, key=lambda x: x[0]):
        new = set()
        for key, text in group:
            cover = bytearray(len(text))
            for a in range(len(text) - 49):
                window = text[a : a + 50]
                new.add(window)
                if window in seen:
                    cover[a : a + 50] = b"\1" * 50
            kept = bytes(x for x, c in zip(text, cover) if not c)
            runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
            out.append((key, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return sorted(out)


def found_repeats(docs):
    rows = suffix_dedup.remove_repeats(docs).collect()
    return sorted(
        (r.doc_id if r.doc_id is not None else 1 << 63, r.n_bytes, sum(s.e - s.s for s in r.spans), len(r.spans), r.kept_sha256)
        for r in rows
    )


def test_repeated_passages(docs_of, odd_texts):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    common, line = letters(130), letters(49)
    rows = [(i, letters(rng.randrange(90)) + common[rng.randrange(60) : 70 + rng.randrange(60)] + letters(40)) for i in range(30)]
    rows += [(50 + i, line + letters(1)) for i in range(20)] + [(90, "a" * 300), (91, "a" * 49), (92, "a" * 77), (89, "ab" * 90)]
    rows += [(i + 100, t) for i, t in enumerate(t for t in odd_texts if len(t or "") < 9000)]
    rows += [(None, common), (None, common), rows[3], (4, "other text " + common)]
    assert found_repeats(docs_of(rows, "names", "doc", "run")) == removed(rows)
    assert found_repeats(docs_of([])) == []


def test_repeated_passages_that_share_one_side(docs_of):
    """Parts of one passage, cut anywhere around every name in it: many runs and halves of a name, few windows."""

    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    whole = letters(90)
    rows = []
    for i in range(400):
        a = rng.randrange(60)
        rows.append((i, letters(rng.randrange(30)) + whole[a : a + rng.randrange(24, 64)] + letters(rng.randrange(30))))
    got = found_repeats(docs_of(rows))
    assert got == removed(rows)
    assert 50 < sum(n > 0 for _, _, n, _, _ in got) < 350


def test_repeated_passages_of_sample(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert found_repeats(sample) == removed(rows)


# Toxicity


def test_toxicity_held_out(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels, where=toxicity.learning_rows())
    held = labels.where(~toxicity.learning_rows()).join(toxicity.score(docs, model), "doc_id").collect()
    hits = [r.toxic for r in held if r.score >= 0.5]
    assert len(hits) > 20 and np.mean(hits) > 0.9  # some labels are at random
    plain = "The meeting starts after lunch and ends before the train leaves."
    odd = {"i d i o t": True, "m.o.r.o.n": True, "st-u-pid": True, "sstupidd": True, "w0rthless": False, "the": False}
    scores = model.probability(model.margins([plain + " " + w for w in odd]))
    for (word, toxic), score in zip(odd.items(), scores):
        if toxic or word == "the":
            assert (score >= 0.5) == toxic, (word, score)


def test_toxicity_odd_rows(spark, docs_of, odd_texts):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    plain = toxicity.learn(docs_of([(1, "bad")]), labels)  # one label only: its share for all
    docs = docs_of(rows_with_ids(odd_texts), "score", "t")
    scored = toxicity.score(docs, plain).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(docs_of([]), plain).count() == 0
    assert toxicity.clean(docs, plain, threshold=2.0).columns == docs.columns
    assert toxicity.clean(docs, plain, threshold=2.0).count() == docs.count()
    kernel = toxicity.Kernel(["abcdef"])
    same, gap, other = kernel.values(["abcdef", "ab-cd-ef", "uvwxyz"])[:, 0]
    assert same == pytest.approx(1) and 0.4 < gap < 1 and other == 0


def test_kernel_by_definition():
    def spectrum(word):
        codes, found = toxicity._codes(word), Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.REACH:
                found[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
        return found

    def value(a, b):
        dot = lambda x, y: sum(v * y[k] for k, v in x.items())
        a, b = spectrum(a), spectrum(b)
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    words = ["banana", "bandana", "bananarama", "cabana", "stupid"]
    got = toxicity.Kernel(words).values(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            want = value(a, b)
            assert got[i, j] == pytest.approx(want if want >= toxicity.FLOOR else 0, abs=1e-5)


# Mixing


def test_mixing(docs_of, odd_texts):
    texts = [t for t in odd_texts] + ["one two three"] * 40
    rows = [(i, t, [None, "b", "a", "Z"][i % 4]) for i, t in enumerate(texts)]
    docs = docs_of(rows, "size", "target", "_s", "_n", "_p", "_in", "_before", "_rest", "_c", "__sum", "Copies")
    mixed = mixing.mix(docs, F.array("source"))
    got = mixed.collect()
    assert all(r[c] == "x" for r in got for c in ("_s", "_n", "_p", "_in", "_before", "_rest", "_c", "__sum"))
    again = mixing.repeat(mixed, ["doc_id", "_c"]).collect()
    assert Counter(r.doc_id for r in again) == +Counter({r.doc_id: r.copies for r in got}) and {r._c for r in again} == {"x"}
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    assert len(got) == len(rows)
    total, taken, goal, largest = Counter(), Counter(), {}, Counter()
    for i, _, s in rows:
        total[s] += size[i]
        largest[s] = max(largest[s], size[i])
    for r in got:
        source = rows[r.doc_id][2]
        assert r.size == size[r.doc_id] and r.source_size == total[source] and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        goal[source] = r.target
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        assert goal[s] <= 2 * total[s] and abs(taken[s] - goal[s]) <= largest[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, F.array("source")).collect()), key=str)
    assert mixing.mix(docs_of([]), F.array("source")).count() == 0


def test_flow_of_overlapping_sources():
    # Both sources want 60 words; "both" can serve either, so nothing is taken twice.
    patterns = {("a",): 40, ("a", "b"): 50, ("b",): 30}
    flows = mixing.route(patterns, {"a": 60.0, "b": 60.0})
    assert sum(flows[p].get("a", 0) for p in patterns) == pytest.approx(60)
    assert sum(flows[p].get("b", 0) for p in patterns) == pytest.approx(60)
    assert all(sum(flows[p].values()) <= n + 1e-6 for p, n in patterns.items())
    # More than all words: each is repeated, none beyond twice.
    flows = mixing.route(patterns, {"a": 100.0, "b": 500.0})
    assert all(sum(flows[p].values()) <= 2 * n + 1e-6 for p, n in patterns.items())


# SimHash


def literal_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs_of, odd_texts):
    texts = [t for t in odd_texts if len(t or "") < 9000] + ["A b C d e"]
    got = {r["_id"]: r.fp % (1 << 64) for r in simhash.fingerprints(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: literal_fingerprint(t) for i, t in enumerate(texts)}


def classes(values, distance):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= distance:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_ball_hashing(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(simhash, "FOLDS", ((bits, None),))
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 20_000)
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(4):
            values.add(value)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                value ^= 1 << b
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from spanloom.llm.components import components
    from spanloom.session import Workspace

    stars = components(simhash.links(spark.createDataFrame(signed, "fp long")), Workspace(spark, "test")).collect()
    joined = {r.a % (1 << 64): r.b % (1 << 64) for r in stars}
    got = defaultdict(set)
    for v in values:
        got[joined.get(v, v)].add(v)
    want = defaultdict(set)
    for v, c in zip(values, classes(values, 4)):
        want[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_copies(docs_of, odd_texts, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want = classes([literal_fingerprint(t) for _, t in rows], 4)
    got = {r.id: r.component for r in simhash.near_copies(sample).collect()}
    best = defaultdict(lambda: 1 << 62)
    for (i, _), c in zip(rows, want):
        best[c] = min(best[c], i)
    assert got == {i: best[c] for (i, _), c in zip(rows, want)}
    docs = docs_of(rows_with_ids(odd_texts), "fp", "component")
    assert simhash.near_copies(docs).count() == docs.count()
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_copies(docs_of([])).count() == 0


# Exact dedup


def test_exact_copies(docs_of, odd_texts):
    texts = odd_texts + ["hot  copy"] * 60 + ["hot copy"] * 60 + ["zz"] * 3
    rows = rows_with_ids(texts)
    docs = docs_of(rows, "kept", "keep_id", "_range")
    got = exact_dedup.mark_copies(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    kept = Counter()
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r.keep_id == (min(ids) if ids else None) and r.group_size == len(groups[norm])
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert exact_dedup.mark_copies(docs_of([])).count() == 0
    assert exact_dedup.keep_first(docs).columns == docs.columns


# Personal data


def literal_pii(text):
    def luhn(s):
        digits = [int(c) for c in s if c.isdigit()][::-1]
        return 16 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0

    find = lambda p: re.finditer(p, text)
    out = [(0, *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [(1, *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if luhn(m.group())]
    out += [(3, *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_of_personal_data(sample, odd_texts):
    rng = random.Random(11)
    texts = [r.text or "" for r in sample.collect()] + [t or "" for t in odd_texts]
    texts += ["".join(rng.choice("ab.@-+_% 12()4 ") for _ in range(60)) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "a@b.cc_d@e.ff", "1.2.3.4.5.6.7.8", "é 999.1.1.1 +1 (234) 555-6789", "a@b c@d.e"]
    for text in texts:
        assert pii.base_spans(text) == literal_pii(text), text


def test_tagger_gradient():
    rng = np.random.default_rng(1)
    model = pii.Tagger(rng)
    codes, tags = rng.integers(32, 120, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    _, gradient = model.gradients(codes, tags)
    for name, value in model.p.items():
        place = np.unravel_index(np.abs(gradient[name]).argmax(), value.shape)
        losses = []
        for step in (1e-5, -1e-5):
            value[place] += step
            losses.append(model.gradients(codes, tags)[0])
            value[place] -= step
        assert gradient[name][place] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_personal_data(docs_of, odd_texts):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    phone = lambda: f"+{rng.randrange(1, 9)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    mail = lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
    texts = [" ".join([word() for _ in range(20)] + [rng.choice((phone, mail))()] + [word() for _ in range(9)]) for _ in range(150)]
    model = pii.fit(texts)
    more = pii.spans_of([f"please write to {mail().replace('@', ' at ').replace('.', ' dot ')} before the end" for _ in range(40)], model)
    assert sum(bool(spans) for _, spans in more) >= 20
    clean = pii.spans_of([" ".join(word() for _ in range(40)) + " 17 of 2023" for _ in range(40)], model)
    assert sum(bool(spans) for _, spans in clean) == 0
    docs = docs_of(rows_with_ids(odd_texts), "spans", "base")
    found = pii.find(docs, model).collect()
    assert len(found) == docs.count() and all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found)
    assert pii.find(docs_of([]), None).count() == 0 and pii.fit(["no spans"]) is None


def test_personal_data_anywhere_in_a_text(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join([word() for _ in range(20)] + [f"{word()}.{word()}@{word()}.com"] + [word() for _ in range(9)]) for _ in range(150)]
    model = pii.fit(texts)
    mails = [f"{word()}.{word()}(at){word()}.com" for _ in range(40)]
    mails += [f"{word()}.{'x'.join(word() for _ in range(9))} [at] {word()} [dot] com" for _ in range(10)]
    parts = [" ".join(word() for _ in range(n % 50)) for n in range(50)]
    found = pii.spans_of([f"{part} {mail} {part}" for part, mail in zip(parts, mails)], model)
    assert sum((0, len(p) + 1, len(p) + 1 + len(m)) in spans for p, m, (_, spans) in zip(parts[:40], mails, found)) >= 20
    bits = ["at", "@", " ", ".", "dot", "(", "a", "b1", "john", "12", "345", "6789", "+1", "-", ", ", "é", "[", "]", "AT", "\n", "_", "the"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(14))
        held = pii._possible(text)
        for a, b in itertools.combinations(range(len(text) + 1), 2):
            if any(pii._valid(k, text[a:b]) for k in range(len(pii.KINDS))):
                assert any(x <= a and b <= y for x, y in held), (text, a, b)
    # The same as from all windows of the grid, also with a model that tags at random.
    mixed = ["".join(rng.choice([*bits, word(), f" {mails[0]} "]) for _ in range(rng.randrange(300))) for _ in range(40)]
    wild = pii.Tagger(np.random.default_rng(5)).light()
    wild.p["out"] *= 9
    own = [pii.spans_of(mixed, m) for m in (model, wild)]
    stride = pii.WINDOW - pii.OVERLAP
    every = lambda t: [(a, min(a + pii.WINDOW, len(t))) for a in range(0, max(1, len(t) - pii.OVERLAP), stride)]
    monkeypatch.setattr(pii, "_layout", every)
    assert own == [pii.spans_of(mixed, m) for m in (model, wild)]


def test_personal_data_learns_from_rare_spans(docs_of, monkeypatch):
    rare = {0: "a.b@mail.example.com", 1: "10.20.30.40", 2: "4111 1111 1111 1111", 3: "+1 (234) 555-6789"}
    rows = [(i, f"order {i} of 2023") for i in range(600)] + [(600 + i, "no number here") for i in range(50)]
    rows += [(700 + k, f"call or write {x}") for k, x in rare.items()] + [(701, f"call or write {rare[1]}")]
    monkeypatch.setattr(pii, "fit", lambda texts: texts)
    texts = pii.learn(docs_of(rows), rows=5)
    assert {k for t in texts for k, _, _ in pii.base_spans(t)} == set(rare)
    assert len(texts) == 4 + 5 + 5 and len(pii.learn(docs_of(rows), rows=1)) == 4 + 1 + 1
    with pytest.warns(UserWarning, match="card"):
        pii.learn(docs_of([r for r in rows if r[0] != 702]), rows=5)


# Quality


def literal_counts(text):
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs_of, odd_texts, sample):
    texts = [t or "" for t in odd_texts] + ["a b c d e a b c d e", "x\nx\n\n x\nx", "#\n#\n" * 9] + [r.text or "" for r in sample.collect()]
    found = quality.counts([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == literal_counts(text)
    # Lines and words that are alike to a polynomial modulo 2^64.
    turn = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = turn.translate(str.maketrans("ab", "ba"))
    for text in (f"{turn}\n{other}\n{turn}", f"a b c d {turn} a b c d {other}", f"{turn} b c d e\t{turn}  b c d e"):
        assert [int(v[0]) for v in quality.counts([text.encode()]).values()] == list(literal_counts(text))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    learn, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = quality.learn(docs, learn)
    judged = held.join(quality.judge(docs, model), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in judged]) > 0.9
    odd = quality.judge(docs_of(rows_with_ids(odd_texts), "kept", "t"), model).collect()
    assert len(odd) == len(odd_texts) + 2 and all(r.base_failed and not r.kept for r in odd if r.n_words < 10)
    assert quality.judge(docs_of([]), model).count() == 0
    assert quality.fit([], []).probability(quality.Parsed.of([b"x"]))[0] == pytest.approx(0.5)


def test_quality_keeps_the_natural_share(spark, docs_of):
    rng = random.Random(17)
    text = lambda: " ".join(rng.choice("one two three four five six seven".split()) for _ in range(30))
    docs = docs_of([(i, text()) for i in range(800)])
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(800)] + [(9000 + i, 0) for i in range(800)], "doc_id long, quality int")
    for rows in (40, 800):
        judged = quality.judge(docs, quality.learn(docs, labels, rows)).collect()
        assert np.mean([r.probability for r in judged]) == pytest.approx(0.9, abs=0.06)


# Secrets


def literal_secrets(text):
    forms = (
        ("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
        ("hex", r"([0-9a-f]+)", 1, 24),
    )
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(forms) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return [(forms[k][0], a, b) for a, k, b in sorted(found)]


def test_secrets(docs_of, odd_texts):
    rng = random.Random(13)
    token = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = list(odd_texts) + [f"é line {i} api_key = '{token(30)}' and some ordinary words follow" for i in range(40)]
    texts += ["secret=token:abcdefgh", "AKIA" * 9, "f" * 23 + " " + "a1" * 20, f"see {token(40)} here", "token: x", "password=abcdef " * 700]
    inner, short = "d0" * 14, token(18)
    texts += [f"mixed {token(20)}G{inner}H{token(20)} here", f"short {short} here", f"my_password={token(24)} end"]
    docs = docs_of(rows_with_ids(texts), "t", "base", "spans", "kind", "_assign", "_tokens", "_random", "__hex")
    found = secrets.find(docs, secrets.learn(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        base = [(s.kind, s.s, s.e) for s in r.base]
        assert base == literal_secrets(r.text or "")
        assert set(base) <= {(s.kind, s.s, s.e) for s in r.spans}
    extra = [r for r in found if (r.text or "").startswith("see ")]
    assert [s.kind for s in extra[0].spans] == [secrets.RANDOM]
    assert all((r._assign, r._tokens, r._random, r["__hex"]) == ("x",) * 4 for r in found)
    # The parts of a random token around a base span, short tokens, and no mark on a name before a value.
    begins = lambda x: next([(s.kind, r.text[s.s : s.e]) for s in r.spans] for r in found if (r.text or "").startswith(x))
    (_, left), middle, (_, right) = begins("mixed ")
    assert middle == ("hex", inner) and len(left) == len(right) == 21
    assert begins("short ") == [(secrets.RANDOM, short)]
    assert [k for k, _ in begins("my_password")] == ["assign"]
    assert secrets.find(docs_of([]), [0.0] * 128 * 128).count() == 0


# Sharding


def test_sharding(docs_of, odd_texts):
    texts = list(odd_texts) + ["hot"] * 400 + [f"text {i // 3}" for i in range(600)] + [f"single {i}" for i in range(200)]
    rows = rows_with_ids(texts)
    got = sharding.shard_documents(docs_of(rows, "shard", "slot", "hub")).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(24))
    sizes = [len(v) for v in by_shard.values()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter((r.size, r.text_crc32) for r in got) == want
    text_of = {zlib.crc32((t or "").encode()): t for _, t in rows}
    spread = defaultdict(set)
    for r in got:
        spread[text_of[r.text_crc32]].add(r.shard)
    triples = [len(v) for t, v in spread.items() if (t or "").startswith("text ")]
    assert np.mean([n == 1 for n in triples]) > 0.8
    assert len(spread["hot"]) < 24
    assert sharding.shard_documents(docs_of([])).count() == 0


# The pipeline


def test_pipeline(spark, sample):
    import corpus_pipeline

    docs = sample
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == sample.columns
        docs = spark.createDataFrame(docs.collect(), sample.schema)
        assert docs.count() <= 2 * before
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    copies = Counter(r.doc_id for r in docs.collect())
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == copies[r.doc_id] * r.doc_tokens for r in packed)
    assert max(copies.values()) <= 2
    rows = corpus_pipeline.run(spark, SF)
    assert sum(r.length for r in rows.collect()) == sum(whole.values())


def test_one_of_each_class_stays_by_row(docs_of):
    """Null and repeated ids: rows are kept by class, not by id."""

    same = "a b c d e f"
    rows = [(None, same), (5, same), (1, same), (1, same), (5, "quite another text of its own here"), (None, "no id and no copy of it"), (None, None)]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows, "row", "key", "th", "fp", "root")).collect())
    assert got == Counter({(1, same): 1, (5, rows[4][1]): 1, (None, rows[5][1]): 1, (None, None): 1})
    assert simhash.keep_one(docs_of(rows).limit(0)).count() == 0


def test_very_long_digit_runs(docs_of):
    """Parts of an address are compared without reading thousands of digits as a number."""

    long = "9" * 5000
    text = f"{long}.2.3.4 {'0' * 5000}12.2.3.4 1.2.3.256 1.2.3.255"
    spans = [s for s in pii.base_spans(text) if s[0] == 1]
    assert [text[a:b][-9:] for _, a, b in spans] == ["012.2.3.4", "1.2.3.255"]


def test_ids_of_words_as_the_tokenizer_gives_them():
    """Special tokens in any case, marks behind letters, letters that lower-case to more than one."""

    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    bits = list("ab cé,.'!İßñ\u0301\u0307Ω 漢ǅ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "İ.", "don't", " 12 ", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_repeats_name_alike_in_blocks_of_any_size(monkeypatch):
    """Names, runs and sums of spans do not depend on how many positions are named at once."""

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (0, 49, 50, 300, 0, 51, 700, 1)]

    def made(block):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        data, ends, owner, first, last, name = suffix_dedup.runs(texts)
        return [*map(list, (ends, owner, first, last, name)), list(suffix_dedup.Spans(data).names(first, last + 50, name))]

    whole = made(1 << 20)
    assert whole[1] and all(made(block) == whole for block in (1, 7, 64, 500))
