"""Whitening against a dense eigenvalue solver."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from spanloom.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, c string, n string"


def triangle(a):
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "cluster", "rank", "wide", "one", "zero"])
def test_solver(kind):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(300, 32)))[0]
    a = {
        "random": lambda: rng.normal(size=(200, 48)),
        "graded": lambda: rng.normal(size=(200, 30)) * 10.0 ** -np.arange(30),
        "equal": lambda: np.vstack([np.eye(20)] * 3),
        "cluster": lambda: basis * np.r_[[3] * 5, [2] * 5, np.ones(22)] @ np.linalg.qr(rng.normal(size=(32, 32)))[0],
        "rank": lambda: rng.normal(size=(100, 9)) @ rng.normal(size=(9, 20)),
        "wide": lambda: rng.normal(size=(12, 20)),
        "one": lambda: rng.normal(size=(50, 1)),
        "zero": lambda: np.zeros((4, 6)),
    }[kind]()
    values, v = whitening.right_singular(triangle(a), min(8, a.shape[1]))
    want = np.linalg.svd(a, compute_uv=False) ** 2
    want = np.concatenate([want, np.zeros(a.shape[1] - len(want))])
    assert np.allclose(values, want, rtol=1e-11, atol=1e-13 * max(want[0], 1e-300))
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(a.T @ a @ v - v * values[: v.shape[1]]).max() <= 1e-12 * max(want[0], 1e-300)


def test_small_values_keep_their_digits():
    """A graded bidiagonal: each value to nearly full relative accuracy, though they span 1e20."""

    d = 10.0 ** -np.arange(11)
    f = d[1:] / 2
    exact = np.linalg.inv(np.diag(d) + np.diag(f, 1))  # its largest values are the reciprocals of the least
    got = whitening.qd_values((d * d).tolist(), (f * f).tolist())
    assert math.isclose(got[-1], np.linalg.svd(exact, compute_uv=False)[0] ** -2, rel_tol=1e-12)


def check(rows, found, components=8):
    """The query's rows against numpy on the vectors that stay."""

    size = max(np.unique([len(c) for _, c in rows], return_counts=True)[0]) if rows else 0
    x = np.floor(1024 * np.array([c for _, c in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, size)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r)
    assert len(found) == n * k
    deviation = {}
    for (key, _), row in zip(rows, (n * x - sums).astype(object)):
        deviation.setdefault(key, []).append(int((row**2).sum()))
    for key, want in deviation.items():
        assert sorted(r.deviation for r in by[key] if r.component == 1) == sorted(want)
    return y, values, vectors, by


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    found = entry.queries()["op11_whitening"](spark, SF).collect()
    y, values, vectors, by = check(rows, found)
    got = np.array([[r.whitened for r in sorted(by[key], key=lambda r: r.component)] for key, _ in rows])
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert {r.n for r in found} == {len(rows)}
    assert max(r.identity_error for r in found) < 1e-9
    for r in found:
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)


def test_odd_rows(spark):
    """Dropped vectors, null and repeated ids, equal rows, directions without variance, clashing columns."""

    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(40, 3)).astype("float32"))]
    good += [(None, good[3][1]), good[5], (7, [1e4, -1e4, 0.0])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, math.nan, 2.0]), (93, [math.inf, 0.0, 1.0]), (94, []), (95, [1.0]), (96, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in good + bad], SCHEMA).repartition(5)
    model = whitening.learn(table)
    found = whitening.whiten(table, model).collect()
    check(good, found)
    assert whitening.identity_error(table, model) < 1e-9

    equal = spark.createDataFrame([(i, [0.5, 0.25], "x", "x", "x") for i in range(4)], SCHEMA)
    model = whitening.learn(equal)
    found = whitening.whiten(equal, model).collect()
    assert len(found) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in found)
    assert whitening.identity_error(equal, model) is None
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "x", "x", "x") for i in range(4)], SCHEMA)
    model = whitening.learn(line)
    assert {(r.component, r.whitened is None) for r in whitening.whiten(line, model).collect()} == {(1, False), (2, True)}
    assert whitening.identity_error(line, model) < 1e-9

    none = table.where("vec_id >= 90")
    assert whitening.learn(none.where("embedding IS NULL")) is None
    assert whitening.whiten(none.limit(0), whitening.learn(none.limit(0))).collect() == []


def test_large_entries_stay_exact(spark):
    """Sums beyond 64 bits: exact, and null where a deviation is no long."""

    rows = [(i, [float(2**50 + i * 2**20), 1.0, 2.0 * i]) for i in range(6)]
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "vec_id long, embedding array<double>, component string, c string, n string")
    model = whitening.learn(table)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(col) for col in zip(*x)]
    assert list(model.sums) == sums
    want = {i: sum((6 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    for r in whitening.whiten(table, model).collect():
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None)
