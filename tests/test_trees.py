"""Tree assembly against named cases and an independent walk of random runs."""

import random

import pytest

from spans import frame, misbehaving_run, span
from spanloom.operators import large_runs
from spanloom.operators.assemble import assemble
from spanloom.operators.recursive import walked
from spanloom.session import Workspace

PLACES = ("order_index", "visit_index", "depth", "orphaned", "promoted")


def walk(rows):
    """Place one run's spans by following the rules literally."""

    key = lambda r: (r["start_time"] is None, r["start_time"], r["seq"], r["span_id"])
    latest = {}
    for r in sorted((r for r in rows if r["span_id"] is not None), key=lambda r: r["seq"]):
        latest[r["span_id"]] = r
    none_safe = lambda r: (r["start_time"] is None, str(r["start_time"]), r["seq"], r["span_id"])
    ordered = sorted(latest.values(), key=none_safe)
    kids = {s: [] for s in latest}
    roots, orphaned, promoted = [], set(), set()
    for r in ordered:
        s, up = r["span_id"], r["parent_span_id"]
        if up is None:
            roots.append(s)
        elif up in latest:
            kids[up].append(s)
        else:
            orphaned.add(s)
            roots.append(s)
    reached = set()

    def reach(s):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += kids[x]

    for s in roots:
        reach(s)
    for r in ordered:
        if r["span_id"] not in reached:
            promoted.add(r["span_id"])
            roots.append(r["span_id"])
            reach(r["span_id"])
    rank = {r["span_id"]: i for i, r in enumerate(ordered)}
    roots.sort(key=rank.get)
    order, depth = [], {}
    todo = [(s, 0) for s in reversed(roots)]
    while todo:
        s, d = todo.pop()
        if s not in depth:
            depth[s] = d
            order.append(s)
            todo += [(k, d + 1) for k in reversed(kids[s])]
    visited, todo = [], list(roots)
    while todo:
        s = todo.pop()
        if s not in visited:
            visited.append(s)
            todo += kids[s]
    return {
        s: (order.index(s), visited.index(s), depth[s], s in orphaned, s in promoted) for s in latest
    }


def random_run(rng, trace_id):
    n = rng.randint(1, 9)
    ids = [f"s{i}" for i in range(n)]
    rows = []
    for i, s in enumerate(ids):
        parent = rng.choice([None, "", "ghost", *ids, *ids, *ids, *ids])
        ms = rng.choice([None, *range(6)])
        rows.append(span(trace_id, s, parent, ms, seq=i))
    if rng.random() < 0.3:
        # A later copy with another parent, and a span without id.
        rows.append(span(trace_id, rng.choice(ids), rng.choice(ids), rng.randint(0, 5), seq=n))
        rows.append(span(trace_id, None, ids[0], 1, seq=n + 1))
    return rows


def placed(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault(r["trace_id"], {})[r["span_id"]] = tuple(r[c] for c in PLACES)
    return out


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(5)
    made = {f"t{i:03d}": random_run(rng, f"t{i:03d}") for i in range(400)}
    made["chain"] = [span("chain", f"c{i}", f"c{i - 1}" if i else None, i) for i in range(300)]
    made["flat"] = [span("flat", "root", None, 0)] + [span("flat", f"k{i}", "root", i % 7, seq=i) for i in range(300)]
    # Enough spans for a search among sorted ids: circles, orphans, empty and missing parents, one id a prefix of others.
    many = [f"s{i}" for i in range(200)]
    made["many"] = [
        span("many", s, rng.choice([None, "", "ghost", "s", "zz", *many[: i + 1], *rng.sample(many, 9)]), rng.choice([None, *range(40)]), seq=i)
        for i, s in enumerate(many)
    ]
    made["bad"] = misbehaving_run()
    made["self"] = [span("self", "a", "a", 0), span("self", "b", "a", -1)]
    # Tails of a two-cycle that start before and after it.
    made["tails"] = [
        span("tails", "a", "b", 5), span("tails", "b", "a", 6),
        span("tails", "early", "a", 1), span("tails", "late", "b", 9), span("tails", "leaf", "early", 0),
    ]
    made["undated"] = [span("undated", s, None, None, seq=i) for i, s in enumerate("cab")]
    return made


@pytest.mark.parametrize("max_rows", [2000, 0, 12])
def test_all_ways_place_spans_like_the_literal_walk(spark, runs, max_rows):
    """In arrays, by linked lists, and with both in one call."""

    spans = frame(spark, [r for rows in runs.values() for r in rows])
    got = placed(assemble(spans, carry=(), max_rows=max_rows))
    want = {t: w for t, w in ((t, walk(rows)) for t, rows in runs.items()) if w}
    assert set(got) == set(want)
    for t in want:
        assert got[t] == want[t], (t, runs[t])
    assert any(p[4] for w in want.values() for p in w.values())


def test_contracted_lists_place_spans_like_the_literal_walk(spark, runs, monkeypatch):
    """Lists contracted as far as they go, circles among them."""

    monkeypatch.setattr(large_runs, "SPARSE", 0)
    spans = frame(spark, [r for rows in runs.values() for r in rows])
    got = placed(assemble(spans, carry=(), max_rows=0))
    assert got == {t: w for t, w in ((t, walk(rows)) for t, rows in runs.items()) if w}


@pytest.mark.parametrize("sparse", [0, 50, 10**6])
def test_suffix_sums_of_lists(spark, monkeypatch, sparse):
    """One long list, many short ones and circles; what is written does not grow with the length."""

    monkeypatch.setattr(large_runs, "SPARSE", sparse)
    work = Workspace(spark)
    rng, rows, want = random.Random(6), [], {}
    ids = rng.sample(range(10**6), 6000)
    lists = [ids[:4000]] + [ids[at : at + 5] for at in range(4000, 5900, 5)]
    for one in lists:
        rows += [(a, b, a % 3, 1) for a, b in zip(one, [*one[1:], None])]
        entries = exits = 0
        for a in reversed(one):
            entries, exits = entries + a % 3, exits + 1
            want[a] = (entries, exits)
    for circle in (ids[5900:5901], ids[5901:5903], ids[5903:]):
        rows += [(a, b, 1, 1) for a, b in zip(circle, [*circle[1:], circle[0]])]
    rng.shuffle(rows)
    steps = work.keep(spark.createDataFrame(rows, "id long, to long, entries long, exits long"), "steps")
    written = []
    kept = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name="t": written.append(r := kept(self, df, name)) or r)
    got = large_runs._suffix_sums(steps, 14, work).collect()
    assert {r.id: (r.entries, r.exits) for r in got if r.to is None} == want
    assert {r.id for r in got if r.to is not None} == set(ids[5900:])
    if sparse == 50:
        # Doubling alone writes twelve times the list or more.
        assert sum(r.count() for r in written) < 6 * len(rows)


def test_runs_with_too_many_bytes_take_the_large_way(spark):
    rows = misbehaving_run()
    for r in rows:
        r["attributes"] = '{"x":"' + "y" * 1000 + '"}'
    spans = frame(spark, rows)
    small = assemble(spans)
    large = assemble(spans, max_bytes=1000)
    assert large.exceptAll(small).count() == 0 and small.exceptAll(large).count() == 0


def test_out_of_order_chain(spark):
    nodes = assemble(frame(spark, [span("t", "c", "b", 2), span("t", "b", "a", 1), span("t", "a", None, 0)]), carry=())
    assert {r["span_id"]: r["depth"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}


def test_orphan_keeps_its_subtree_unflagged(spark):
    nodes = assemble(
        frame(spark, [span("t", "root", None, 0), span("t", "lost", "ghost", 1), span("t", "kid", "lost", 2)]), carry=()
    )
    got = {r["span_id"]: (r["orphaned"], r["depth"]) for r in nodes.collect()}
    assert got == {"root": (False, 0), "lost": (True, 0), "kid": (False, 1)}


def test_last_copy_wins_by_arrival(spark):
    from spans import at

    rows = [
        span("t", "a", None, 0, name="new", ingested_at=at(9), seq=1),
        span("t", "a", None, 0, name="old", ingested_at=at(5), seq=7),
    ]
    assert [r["name"] for r in assemble(frame(spark, rows), carry=("name",)).collect()] == ["new"]


def test_one_run_only(spark):
    spans = frame(spark, [span("t", "a"), span("u", "a")])
    assert [r["trace_id"] for r in assemble(spans, carry=(), trace_id="u").collect()] == ["u"]
    assert assemble(spans, carry=(), trace_id="none").count() == 0


def test_key_lists_of_any_length_filter_alike(spark, monkeypatch):
    from spanloom.operators import skew

    rows = spark.range(1000).selectExpr("string(id % 7) AS k", "id")
    keys = spark.createDataFrame([("1",), ("3",)], "k string")
    assert skew.fits_broadcast(keys, "k")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    assert not skew.fits_broadcast(keys, "k")
    for keep in (True, False):
        short = skew.keep_or_drop_keys(rows, keys, True, "k", keep)
        long = skew.keep_or_drop_keys(rows, keys, False, "k", keep).select("k", "id")
        assert sorted(short.collect()) == sorted(long.collect())


def test_rows_are_numbered_without_gaps(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.skew import number_rows
    from spanloom.session import Workspace

    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v").repartition(7)
    got = number_rows(df, [F.col("v")], Workspace(spark)).collect()
    assert sorted((r["v"], r["pos"]) for r in got) == [(i, i + 1) for i in range(5000)]


def test_a_walk_of_more_rows_than_the_sessions_limit(spark):
    """The limit on rows is lifted until the walk has run, and then as before."""

    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = walked(frame(spark, [span(t, str(i), str(i - 1) if i else None, i) for t in "ab" for i in range(5)])).collect()
        assert spark.conf.get(key) == "3"
    finally:
        spark.conf.set(key, before)
    assert sorted((r.trace_id, r.span_id, r.depth, len(r.path)) for r in got) == [(t, str(i), i, i + 1) for t in "ab" for i in range(5)]
