"""Whitening: eigenvectors against LAPACK, the query against plain numpy, hot vectors and unusable rows."""

import numpy as np
import pytest

from kpiforge.llm import queries
from kpiforge.llm.whitening import eigen, polar_factor, whiten
from kpiforge.sources.tables import read_table

SCHEMA = "vec_id long, embedding array<double>, dims int, x string, component int"


def matrices():
    rng = np.random.default_rng(3)
    yield "spread", (lambda a: a @ a.T)(rng.normal(size=(40, 60)) * np.linspace(0.1, 30, 60))
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    yield "repeated eigenvalues", (q * np.repeat([5.0, 2.0, 1.0], 8)) @ q.T
    yield "two close ones", (q * (np.arange(24) // 2 + 1e-9 * np.arange(24) + 1)) @ q.T
    yield "rank one", np.outer(q[0], q[0])
    yield "multiple of the identity", 7 * np.eye(5)
    yield "diagonal", np.diag([3.0, 9.0, 1.0, 4.0])
    yield "one by one", np.array([[2.5]])
    yield "zero", np.zeros((4, 4))
    yield "large range", (q * np.logspace(8, -4, 24)) @ q.T


@pytest.mark.parametrize("name,v", list(matrices()), ids=[n for n, _ in matrices()])
def test_eigen(name, v):
    v = (v + v.T) / 2
    e, q = eigen(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.allclose(q.T @ q, np.eye(len(v)), atol=1e-13)
    assert np.linalg.norm(v @ q - q * e) <= 1e-13 * size
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size)


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.allclose(polar_factor(a), (q * np.sign(w)) @ q.T, atol=1e-12)


def brute(rows, most=16):
    good = [(i, np.floor(64 * np.array(v)).astype(object)) for i, v in rows]
    x = np.array(sorted({tuple(int(c) + 1000000 for c in v) for _, v in good}), float)
    n, mean = len(x), x.mean(0)
    v = (x - mean).T @ (x - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    ints = np.array(sorted({tuple(int(c) + 1000000 for c in v) for _, v in good}), dtype=object)
    s = ints.sum(0)
    out = []
    for i, c in good:
        t = c + 1000000
        out.append((i, int(sum((n * a - b) ** 2 for a, b in zip(t, s))), ((t - s / n).astype(float) @ q) / np.sqrt(e)))
    return n, e / e.sum(), out


def compare(got, rows):
    n, share, want = brute(rows)
    k = min(16, len(share))
    assert len(got) == k * len(want)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, dev, w in sorted(want, key=lambda t: -abs(t[2][:k]).min()):
        own = by[i]
        assert sorted(own) == list(range(1, k + 1))
        have = np.array([own[c]["whitened"] for c in range(1, k + 1)])
        signs = np.sign(have * w[:k]) if signs is None else signs  # of the row farthest from zero
        assert np.allclose(have, signs * w[:k], rtol=1e-9, atol=1e-9)
        assert {r["n"] for r in own.values()} == {n} and {r["deviation"] for r in own.values()} == {dev}
        assert np.allclose([own[c]["explained"] for c in range(1, k + 1)], share[:k], rtol=1e-10)
        assert all(0 <= r["identity_error"] <= 1e-9 for r in own.values())


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20) + np.linspace(-1, 5, 20)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)]  # a hot vector, counted once in the fit list
    rows += [(2000 + k, [c + 1e-9 for c in rows[k][1]]) for k in range(5)]
    odd = [(5000, None), (5001, [float("nan")] * 20), (5002, [None] + [1.0] * 19), (5003, [float("inf")] + [0.0] * 19), (5004, []),
           (5005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3, "x", 9) for i, v in rows + odd], SCHEMA)
    compare(whiten(df).collect(), rows)
    # the same statistics however the rows are dealt
    a = sorted(map(tuple, whiten(df.repartition(7)).collect()))
    b = sorted(map(tuple, whiten(df.repartition(2)).collect()))
    assert [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-12)


def test_given_embeddings(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in read_table(spark, sf, "embeddings").collect()]
    compare(queries.op13_embedding_whitening(spark, sf).collect(), rows)


def test_cases(spark):
    def run(rows, **k):
        return whiten(spark.createDataFrame([(i, v, 3, "x", 9) for i, v in rows], SCHEMA), **k).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    two = run([(None, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])])
    assert sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 9))) for r in two), key=str) == sorted(
        [(None, 1, 2, 64 ** 2, 1.0), (1, 1, 2, 64 ** 2, 1.0), (1, 1, 2, 64 ** 2, 1.0)], key=str)
    wide = run([(k, [float(k * k % 7), 1e12 * (k % 5), 1e300 if k == 3 else 0.0]) for k in range(40)])
    assert {r["component"] for r in wide} <= {1, 2, 3} and any(r["deviation"] is None for r in wide)
    assert len(run([(k, [float(k % 3), float(k % 5)]) for k in range(15)], components=1)) == 15
