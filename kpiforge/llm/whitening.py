"""Embedding whitening by QDWH spectral divide and conquer.

``whiten(rows)`` turns every entry c of a vector into the integer
``x = floor(64 * c) + 1000000`` and projects each vector on the leading
eigenvectors of the integers' covariance, scaled to variance one.  The
covariance is taken over the *fit list*: each distinct integer vector once.

Statistics are sums of integers, so they are exact and do not depend on how
the rows were dealt: one pass adds up the fit list, the next adds the products
of the entries after the integer nearest their mean was taken off (the
fraction that remains is taken off the result).  Tasks add what they hold, and
a group per matrix row adds one short row of each task.

The eigenvectors come from polar decompositions alone (:func:`eigen`): the
orthogonal polar factor U of ``V - s I`` by dynamically weighted Halley
iterations (QR steps first, Cholesky steps near convergence) gives the
projector ``(I + U) / 2`` on the eigenvectors above s; bases of its range and
of its complement split V into two smaller blocks, and so on down to blocks
that are multiples of the identity.  That matrix has the vectors' dimension
and is the only thing the driver computes with; the whitening map
(dimension x components) is broadcast, and a last pass over the fit list
measures the covariance of the whitened vectors.

Cases.  Null vectors and vectors with a null or non-finite entry are dropped;
vectors of another length than most distinct vectors have (the longer length
of two as frequent) are dropped too.  Scaled entries beyond 2**61 count as
2**61.  Directions without variance (relative to the largest, 1e-13) are no
components: a table of equal vectors has no rows.  A deviation beyond a long
is null.  Null ids stay, repeated rows stay.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import same_type, stored

SCALE, SHIFT = 64, 1_000_000
MOST = 2 ** 61  # of a scaled entry
FLAT = 1e-13  # variance of a direction, relative to the largest, that counts as none

# ------------------------------------------------------------------ eigenvectors of a symmetric matrix


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix (its matrix sign) by QDWH."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x, eye, low = a / norm, np.eye(n), 1e-16  # low: a bound below the smallest singular value of x, or what is lost anyway
    for _ in range(20):
        d = (4 * (1 - low ** 2) / low ** 4) ** (1 / 3)
        r = np.sqrt(1 + d)
        wa = r + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * r))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * q[:n] @ q[n:].T
        else:
            half = np.linalg.cholesky(eye + wc * x.T @ x)
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low ** 2) / (1 + wc * low ** 2), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 1e-15 * n or (1 - low < 1e-15 and moved <= 1e-8):
            break
        low = min(low, 1 - 1e-16)
    return x


def _halves(h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None for a block with one eigenvalue."""
    k = len(h)
    middle = h - np.eye(k) * (np.trace(h) / k)
    spread = np.linalg.norm(middle)
    if spread <= 4e-16 * k * np.linalg.norm(h) or spread == 0:
        return None
    diagonal = np.sort(np.diag(h))
    best = None
    # the median of the diagonal halves the work; the mean of the eigenvalues always lies between two of them
    for shift in (diagonal[k // 2 - 1: k // 2 + 1].mean(), np.trace(h) / k, np.trace(h) / k + 0.1 * spread / k, np.trace(h) / k - 0.1 * spread / k):
        p = (polar_factor(h - shift * np.eye(k)) + np.eye(k)) / 2
        rank = int(round(float(np.trace(p))))
        if not 0 < rank < k:
            continue
        start = np.random.default_rng(seed).normal(size=(k, rank))
        q = np.linalg.qr(p @ start, mode="complete")[0]
        for _ in range(2):
            q = np.linalg.qr(p @ q[:, :rank], mode="complete")[0]
        loss = np.linalg.norm(q[:, rank:].T @ h @ q[:, :rank])
        if best is None or loss < best[0]:
            best = loss, q[:, :rank], q[:, rank:]
        if loss <= 1e-14 * k * np.linalg.norm(h):
            break
    return None if best is None else best[1:]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(v)
    todo, values, vectors = [(v, np.eye(n))], [], []
    while todo:
        h, basis = todo.pop()
        halves = _halves(h, len(todo) + len(values)) if len(h) > 1 else None
        if halves is None:
            values.append(np.diag(h))
            vectors.append(basis)
            continue
        for q in halves:
            part = q.T @ h @ q
            todo.append(((part + part.T) / 2, basis @ q))
    e, q = np.concatenate(values), np.hstack(vectors)
    # what rounding left between the subspaces, to first order: well separated pairs turn by residual / gap
    for _ in range(2):
        r, s = np.eye(n) - q.T @ q, q.T @ v @ q
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > 1e-9 * np.abs(e).max()
        turn = np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        np.fill_diagonal(turn, np.diag(r) / 2)
        q = q + q @ turn
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


# ------------------------------------------------------------------ vectors as integers


def _integers(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """Usable rows of a vector column by length: row numbers, and their entries as integers (without the shift)."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = arr.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(size[~np.isnan(size)] if size.dtype.kind == "f" else size):
        own = np.flatnonzero(size == d)
        if d < 1:
            continue
        c = arr.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), int(d))
        ok = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            out.append((own[ok], np.clip(np.floor(SCALE * c[ok]), -MOST, MOST).astype(np.int64)))
    return out


def _packed(batches):
    """``dims, x``: entries in the fewest bytes that hold all of a row's, so equal vectors are equal bytes."""
    for batch in batches:
        for _, x in _integers(batch.column(0)):
            most = np.abs(x).max(1, initial=0)
            for lo, hi, kind in ((-1, 2 ** 15 - 1, "<i2"), (2 ** 15 - 1, 2 ** 31 - 1, "<i4"), (2 ** 31 - 1, 2 ** 63 - 1, "<i8")):
                rows = x[(most > lo) & (most <= hi)].astype(kind)
                if len(rows):
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), raw.cast(pa.binary())], ["dims", "x"])


def _unpacked(col, dims: int):
    """The integer rows of packed vectors, one array for each width."""
    width = col.to_pandas().str.len().to_numpy() // dims
    for w in np.unique(width):
        rows = col.take(pa.array(np.flatnonzero(width == w)))
        yield np.frombuffer(b"".join(rows.to_pylist()), f"<i{w}").reshape(len(rows), dims).astype(np.int64)


def _accumulated(fit: DataFrame, dims: int, shape: tuple[int, int], kind: type, add: Callable, join: Callable) -> np.ndarray:
    """A matrix that every task adds up over its rows (``add(matrix, x)``); the tasks' matrices meet row by row, in the order of
    their partitions (``join`` of a stack of rows), so a group holds one short row of each task."""
    def run(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for x in _unpacked(batch.column(0), dims):
                total = add(total, x)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(np.full(shape[0], part, np.int32)),
                                          pa.array([row.tobytes() for row in total], pa.binary())], ["i", "part", "row"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").column("row").to_pylist()
        row = join(np.frombuffer(b"".join(rows), kind).reshape(len(rows), shape[1])).astype(kind)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})

    rows = fit.select("x").mapInArrow(run, "i int, part int, row binary").groupBy("i").applyInArrow(merge, "i int, row binary").collect()
    out = np.zeros(shape, kind)
    for r in rows:
        out[r["i"]] = np.frombuffer(r["row"], kind)
    return out


class Whitening(NamedTuple):
    """What the fit list gives: its size, the sums of x without the shift, the map (dims x components), shares of the variance."""

    n: int
    sums: list
    most: int
    turn: np.ndarray
    explained: np.ndarray
    identity_error: float


def _centred(x: np.ndarray, n: int, sums: list, most: int) -> np.ndarray:
    """``x - S / n`` in doubles, from the exact ``n * x - S`` where longs hold it."""
    if 2 * n * max(most, 1) < 2 ** 62:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def fit(rows: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of a table of vectors (None without vectors, or without variance)."""
    src = same_type(rows, {vector: "array<double>"})
    distinct = stored(src.mapInArrow(_packed, "dims int, x binary").distinct(), "whiten-fit")
    lengths = distinct.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return None
    dims = lengths[0]["dims"]
    own = distinct.where(F.col("dims") == dims)

    def count(total, x):  # sums in two limbs: no sum of longs overflows
        total = total.copy()
        total[0, :dims] += (x >> 31).sum(0)
        total[0, dims: 2 * dims] += (x & (2 ** 31 - 1)).sum(0)
        total[0, -2] += len(x)
        total[0, -1] = max(total[0, -1], np.abs(x).max(initial=0))
        return total

    first = _accumulated(own, dims, (1, 2 * dims + 2), np.int64, count, lambda a: np.append(a[:, :-1].sum(0), a[:, -1].max()))[0]
    n, most = int(first[-2]), int(first[-1])
    sums = [(int(h) << 31) + int(lo) for h, lo in zip(first[:dims], first[dims: 2 * dims])]
    near = [(2 * s + n) // (2 * n) for s in sums]  # the integer nearest the mean
    wide = 2 * most + 1
    exact = n * wide ** 2 < 2 ** 62
    centre = np.array(near, np.int64)

    def product(total, x):
        z = (x - centre).astype(np.float64)
        step = max(1, min(len(z), 2 ** 53 // wide ** 2 if exact else len(z)))  # so many products add up exactly in doubles
        for k in range(0, len(z), step):
            part = z[k: k + step].T @ z[k: k + step]
            total = total + (part.astype(np.int64) if exact else part)
        return total

    gram = _accumulated(own, dims, (dims, dims), np.int64 if exact else np.float64, product, lambda a: a.sum(0))
    rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])
    v = gram / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    e, q = eigen(v)
    k = min(components, int((e > FLAT * max(e[0], 0)).sum()) if e[0] > 0 else 0)
    if k == 0:
        return None
    turn = q[:, :k] / np.sqrt(e[:k])

    def spread(total, x):
        w = np.hstack([np.ones((len(x), 1)), _centred(x, n, sums, most) @ turn])
        return total + w.T @ w

    seen = _accumulated(own, dims, (k + 1, k + 1), np.float64, spread, lambda a: a.sum(0)) / n
    error = float(np.abs(seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:]) - np.eye(k)).max())
    return Whitening(n, sums, most, turn, e[:k] / np.trace(v), error)


def _deviation(x: np.ndarray, n: int, sums: list, most: int) -> pa.Array:
    """Sum over dimensions of ``(n * x - S) ** 2``; null beyond a long."""
    reach = n * most + max(abs(s) for s in sums)
    if x.shape[1] * reach ** 2 < 2 ** 63:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(1))
    about = ((float(n) * x - np.array([float(s) for s in sums])) ** 2).sum(1)
    out = [None] * len(x)
    for k in np.flatnonzero(about < 1.01 * 2.0 ** 63):
        total = sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums))
        out[k] = total if total < 2 ** 63 else None
    return pa.array(out, pa.int64())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    src = same_type(rows, {vec_id: "long", vector: "array<double>"})
    if model is None:
        return src.sparkSession.createDataFrame([], _OUT)
    held = src.sparkSession.sparkContext.broadcast(model)  # dimension x components doubles

    def run(batches):
        m = held.value
        dims, k = m.turn.shape
        for batch in batches:
            for own, x in _integers(batch.column(1)):
                if x.shape[1] != dims or not len(own):
                    continue
                whitened = _centred(x, m.n, m.sums, m.most) @ m.turn
                at = np.repeat(np.arange(len(own)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(own[at])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(at), m.n)), _deviation(x, m.n, m.sums, m.most).take(pa.array(at)), pa.array(whitened.ravel()),
                    pa.array(np.tile(m.explained, len(own))), pa.array(np.full(len(at), m.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(run, _OUT)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the table's distinct vectors and whiten every row of it."""
    return apply(rows, fit(rows, vector, components), vec_id, vector)
