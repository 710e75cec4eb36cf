"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

The centred rows are reduced to one triangle R: each task folds its rows in
blocks into a triangle, and triangles are folded together in groups, level by
level, so that only d x d numbers ever reach the driver (d: entries a vector).
R has the rows' singular values. It is brought to bidiagonal form B by
Householder reflections; dqds sweeps with shifts that never exceed the least
value left find the squares of B's singular values to high relative accuracy;
and twisted factorisations of B'B - value give the right singular vectors, which
are the covariance's eigenvectors.

Entries are whole numbers before centring, so sums are exact, and a centred entry
is (n * x - S) / n, rounded once it has been formed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.session import Workspace

SCALE, LIFT = 1024, 100_000  # x = floor(SCALE * c) + LIFT
COMPONENTS = 8
BLOCK_ROWS = 4_096
FAN = 32  # triangles folded together at once
LARGEST = 2.0**52  # of an entry's size: beyond, x is no long

_EPS = np.finfo(float).eps
_CLUSTER = 1e-3  # relative distance of values whose vectors are made orthogonal
_INT = 1 << 62


def householder_bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V' for an orthogonal U."""

    a = np.array(r, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        w = x / norm
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < n:
            w = reflector(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds sweep: the next q and e, and the d of each step."""

    ds, nq, ne = [q[0] - shift], [], []
    for k in range(len(e)):
        top = ds[k] + e[k]
        ratio = q[k + 1] / top if top else 0.0
        nq.append(top)
        ne.append(e[k] * ratio)
        ds.append(ds[k] * ratio - shift)
    nq.append(ds[-1])
    return nq, ne, ds


def qd_values(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal with squared entries q and e, falling."""

    found: list[float] = []
    todo = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while todo:
        q, e, past = todo.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _EPS * _EPS * (past + min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], past))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # The sum of 1 / d is the trace of the inverse: its reciprocal is at most the least value.
            nq, ne, ds = _sweep(q, e, 0.0)
            shift = 0.0 if min(ds) <= 0 else (1 - 4 * len(ds) * _EPS) / sum(1 / d for d in ds)
            while shift > _EPS * _EPS * past:
                tq, te, td = _sweep(q, e, shift)
                if min(td) >= 0:
                    nq, ne, past = tq, te, past + shift
                    break
                shift /= 4
            q, e = nq, ne
        found.append(past + q[0])
    return sorted(found, reverse=True)


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factorisations of B'B - value: gamma, and the multipliers above and below the twist."""

    n = len(q)
    tiny = max(q.max(), 1e-300) * _EPS * _EPS
    pivots = np.where(q > tiny, q, tiny)
    low = np.sqrt(e / pivots[:-1])
    s, p = np.empty(n), np.empty(n)
    up, down = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    safe = lambda x: x if abs(x) > tiny else np.copysign(tiny, x)
    s[0] = -value
    for i in range(n - 1):  # stationary
        up[i] = pivots[i] * low[i] / safe(pivots[i] + s[i])
        s[i + 1] = up[i] * low[i] * s[i] - value
    p[-1] = pivots[-1] - value
    for i in range(n - 2, -1, -1):  # progressive
        ratio = pivots[i] / safe(pivots[i] * low[i] ** 2 + p[i + 1])
        down[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    return s + p + value, up, down


def _vector(gamma_at: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    z = np.zeros(len(up) + 1)
    z[gamma_at] = 1
    for i in range(gamma_at - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(gamma_at, len(up)):
        z[i + 1] = -down[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= 1e150
    return z / np.linalg.norm(z)


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, all of them, falling; the first ``count`` right vectors as columns)."""

    n = len(r)
    scale = np.abs(r).max() if r.size else 0.0
    if not scale:
        return np.zeros(n), np.eye(n)[:, :count]
    d, f, v = householder_bidiagonal(r / scale)
    # |B| = L B T for diagonal signs L and T: B'B has T times the vectors of |B|'|B|.
    signs = np.ones(n)
    for k in range(n - 1):
        signs[k + 1] = signs[k] * np.copysign(1, d[k]) * np.copysign(1, f[k])
    q, e = d * d, f * f
    # So small an entry moves each value by less than its rounding.
    small = np.abs(f) <= _EPS * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))
    cuts = [0, *(np.flatnonzero(small) + 1).tolist(), n]
    parts = [(value, a, b) for a, b in zip(cuts, cuts[1:]) for value in qd_values(q[a:b].tolist(), e[a : b - 1].tolist())]
    parts.sort(key=lambda x: -x[0])

    columns: list[tuple[float, np.ndarray]] = []
    for value, a, b in parts[:count]:
        near = [z for other, z in columns if other - value <= _CLUSTER * other]
        gamma, up, down = _twisted(q[a:b], e[a : b - 1], value)
        best, most = np.zeros(n), -1.0
        # Equal values share a space: another twist gives another vector of it,
        # where its remainder, gamma at the twist by the vector's length, is small too.
        for at in np.argsort(np.abs(gamma), kind="stable"):
            z = np.zeros(n)
            z[a:b] = _vector(int(at), up, down)
            if most >= 0 and abs(gamma[at] * z[a + at]) > 64 * n * _EPS * q[a:b].max():
                continue
            for _ in range(2):
                for other in near:
                    z -= (other @ z) * other
            left = np.linalg.norm(z)
            if left > most:
                best, most = z / max(left, 1e-300), left
            if left > 0.5:
                break
        columns.append((value, best))
    basis = np.stack([signs * z for _, z in columns], axis=1) if columns else np.zeros((n, 0))
    return np.array([value for value, *_ in parts]) * scale * scale, v @ basis


@dataclass(frozen=True)
class Whitening:
    """``explained`` and ``values`` go with the columns of ``directions``."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, c): vectors without null or non-finite entries, as doubles."""

    c = F.col(vector_column).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    given = rows.select(F.col(id_column).alias("vec_id"), c.alias("c"))
    return given.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fine))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, size: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, x as rows) for vectors of ``size``, or for each size there is."""

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for d in np.unique(lengths).tolist() if size is None else [size]:
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), BLOCK_ROWS):
                some = rows[at : at + BLOCK_ROWS]
                c = flat[ends[some][:, None] + np.arange(d)[None, :]]
                yield some, np.floor(SCALE * c).astype(np.int64) + LIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(h << 32) + w for h, w in zip(high.tolist(), low.tolist())]


def _spread(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: 64-bit if they hold it, else Python's integers."""

    fits = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < _INT
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def _centred(spread: np.ndarray, n: int) -> np.ndarray:
    return (spread / n).astype(float)


def _deviations(spread: np.ndarray) -> list[int | None]:
    largest = int(np.abs(spread).max(initial=0))
    if spread.dtype != object and largest * largest * spread.shape[1] < _INT:
        return (spread * spread).sum(axis=1).tolist()
    exact = (spread.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def _sums(vectors: DataFrame) -> tuple[int, int, tuple[int, ...]]:
    """(d, n, S): the entries of a vector, their number, and exact sums."""

    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for rows, x in _blocks(batches, "c", None):
            d = x.shape[1]
            own = held.setdefault(d, [0, [0] * d])
            own[0] += len(rows)
            own[1] = [p + q for p, q in zip(own[1], _exact_sums(x))]
        for d, (n, total) in held.items():
            columns = [pa.array([d] * d), pa.array(range(d)), pa.array([n] * d), pa.array(list(map(Decimal, total)), kind)]
            yield pa.record_batch(columns, names=["d", "i", "n", "s"])

    parts = vectors.select("c").mapInArrow(run, "d long, i long, n long, s decimal(38,0)")
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    # The commonest number of entries; the larger of two as common ones.
    top = sums.withColumn("top", F.max(F.struct("n", "d")).over(_everything())).where(F.col("d") == F.col("top.d"))
    drawn = sorted(top.select("i", "d", "n", "s").collect())
    return (drawn[0].d, drawn[0].n, tuple(int(r.s) for r in drawn)) if drawn else (0, 0, ())


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # one row for each entry of a vector


def _triangle(vectors: DataFrame, d: int, n: int, sums: tuple[int, ...], work: Workspace) -> np.ndarray:
    """R of the centred rows, by a tree of blockwise QR factorisations."""

    def fold(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([held, rows]), mode="r")

    def out(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()])], names=["part", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for _, x in _blocks(batches, "c", d):
            r = fold(r, _centred(_spread(x, n, sums), n))
        if len(r):
            yield out(TaskContext.get().partitionId(), r)

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        held = sorted((p, b) for x in batches for p, b in zip(x.column("part").to_pylist(), x.column("r").to_pylist()))
        for _, block in held:
            r = fold(r, np.frombuffer(block).reshape(-1, d))
        yield out(key[0].as_py(), r)

    parts = work.keep(vectors.select("c").mapInArrow(reduce_rows, "part long, r binary"), "triangles")
    while parts.count() > 1:
        some = parts.select(F.floor(F.col("part") / FAN).alias("group"), "part", "r")
        parts = work.keep(some.groupBy("group").applyInArrow(join, "part long, r binary"), "triangles")
    r = np.frombuffer(parts.first().r).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def learn(
    rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding", work: Workspace | None = None
) -> Whitening | None:
    """The whitening of all usable vectors of ``rows``; None if there are none."""

    work = work or Workspace(rows.sparkSession, "whitening")
    vectors = usable(rows, id_column, vector_column)
    d, n, sums = _sums(vectors)
    if not n:
        return None
    values, directions = right_singular(_triangle(vectors, d, n, sums, work), min(components, d))
    values = values / n
    trace = values.sum()
    some = values[: directions.shape[1]]
    # What rounding leaves of a direction without variance is none.
    some = np.where(some > (16 * d * _EPS) ** 2 * max(values[0], 0), some, 0.0)
    return Whitening(n, sums, directions, some, some / trace if trace else np.zeros(len(some)))


def _project(model: Whitening, spread: np.ndarray) -> np.ndarray:
    scale = np.divide(1, np.sqrt(model.values), out=np.full(len(model.values), np.nan), where=model.values > 0)
    return _centred(spread, model.n) @ model.directions * scale


def identity_error(rows: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, over directions with variance."""

    live = np.flatnonzero(model.values > 0)
    d = len(model.sums)
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for _, x in _blocks(batches, "c", d):
            w = _project(model, _spread(x, model.n, model.sums))[:, live]
            total += w.sum(axis=0)
            square += w.T @ w
        for i, (t, row) in enumerate(zip(total.tolist(), square.tolist())):
            yield pa.record_batch([pa.array([i] * (len(live) + 1)), pa.array(range(-1, len(live))), pa.array([t, *row])], names=["i", "j", "s"])

    parts = usable(rows, id_column, vector_column).select("c").mapInArrow(run, "i long, j long, s double")
    sums = {(r.i, r.j): r.s / model.n for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}  # components squared
    means = np.array([sums[i, -1] for i in range(len(live))])
    found = np.array([[sums[i, j] for j in range(len(live))] for i in range(len(live))])
    return float(np.abs(found - np.outer(means, means) - np.eye(len(live))).max())


def whiten(rows: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, deviation, whitened, explained): a row for each usable vector and component.

    Vectors that are null or empty, hold null or non-finite entries (or entries
    of 2**52 and more, for which x is no long), or have another number of entries
    than most, are dropped. A vector has as many rows as the model has components:
    at most the number of entries. ``whitened`` is null along a direction in which
    nothing varies (one row, all rows equal, more entries than rows);
    ``deviation`` is null where it exceeds a long. Null and repeated ids are
    vectors like others; equal values share a space, of which any basis serves.
    Other input columns play no part. An empty table gives none.
    """

    out = "vec_id {}, component int, deviation long, whitened double, explained double"
    vectors = usable(rows, id_column, vector_column)
    out = out.format(dict(vectors.dtypes)["vec_id"])
    if model is None:
        return vectors.limit(0).selectExpr("vec_id", "0 AS component", "0L AS deviation", "0D AS whitened", "0D AS explained")
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _blocks(iter([batch]), "c", d):
                spread = _spread(x, model.n, model.sums)
                w = _project(model, spread).ravel()
                take = pa.array(np.repeat(places, k))
                columns = [
                    batch.column(0).take(take),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                    pa.array([v for v in _deviations(spread) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(model.explained, len(places))),
                ]
                yield pa.record_batch(columns, names=["vec_id", "component", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, out)
