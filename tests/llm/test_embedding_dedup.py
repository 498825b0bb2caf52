"""Embeddings: links and components against all pairs, hot vectors, and unusable rows."""

import numpy as np
import pytest

from kpiforge.llm import embedding_dedup
from kpiforge.llm.embedding_dedup import buckets, candidates, hadamard, near_duplicates, shape

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, v string, t int"


def brute(rows, cosine=0.98):
    usable = []
    for _, v, label in rows:
        ok = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(np.array(v, np.float32), np.float64) if ok else None)
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = usable[a], usable[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y >= cosine * np.sqrt(x @ x) * np.sqrt(y @ y):
                    links[a] += 1
                    links[b] += 1
                    up[root(a)] = root(b)
    low = {}
    for k, r in enumerate(rows):
        low[root(k)] = min(low.get(root(k), r[0]), r[0])
    return sorted((r[0], links[k], low[root(k)], r[0] == low[root(k)]) for k, r in enumerate(rows))


def corpus(seed, d=32, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d))
    rows = []
    for i in range(n):
        c = centres[rng.integers(25)] if i % 3 else rng.normal(size=d)
        v = c + rng.normal(size=d) * rng.choice([0, 0.05, 0.15, 0.25])
        rows.append((int(i), [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    rows += [(1000 + k, rows[1][1], rows[1][2]) for k in range(90)]  # a hot vector
    rows += [(2000, None, 1), (2001, [0.0] * d, 1), (2002, [float("nan")] + [1.0] * (d - 1), 1), (2003, rows[1][1], None),
             (2004, [None] + [1.0] * (d - 1), 1), (2005, [float("inf")] * d, 1), (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1),
             (2009, [x * 3 for x in rows[1][1]], rows[1][2])]
    return rows


@pytest.mark.parametrize("d", [32, 20])
def test_equal_to_all_pairs(spark, d, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # hot buckets are cut into several query blocks
    if d == 20:  # every block as matrix products
        monkeypatch.setattr(embedding_dedup.close_pairs, "__defaults__", (0,))
    rows = corpus(d, d)
    got = near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_near_copies_of_one_vector_stay_in_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in (centre + rng.normal(size=16) * 0.02).astype(np.float32)], 0) for i in range(600)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "GROUP", 512, raising=False)
    verify = embedding_dedup._verify

    def bounded(*args):
        check = verify(*args)

        def run(table):
            blocks = table.group_by(["label", "t", "bucket", "dims", "salt", "query"]).aggregate([("cid", "count")])
            if max(blocks.column("cid_count").to_pylist(), default=0) > 3 * 32 or table.num_rows > 8 * 512:
                raise ValueError("a group holds too many vectors")
            return check(table)

        return run

    monkeypatch.setattr(embedding_dedup, "_verify", bounded)
    got = near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * e
    for vectors in (1000, 10 ** 7):
        tables, width = shape(vectors, 64)
        met = np.zeros(len(x), bool)
        for t in range(tables):
            met |= (buckets(x, t, width) == buckets(y, t, width)[:, :1]).any(1)
        assert met.mean() > 0.999, (tables, width)


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(hadamard(y), x)


def test_candidates_are_all_pairs_of_each_block():
    queries, index = np.array([2, 0, 3, 1]), np.array([3, 2, 0, 1])
    first = np.cumsum(queries + index) - queries - index
    got = [p for a, b in candidates(queries, index, first, most=4) for p in zip(a.tolist(), b.tolist())]
    want = [(f + i, f + q + j) for q, n, f in zip(queries, index, first) for i in range(q) for j in range(n)]
    assert got == want and shape(10, 64) == (6, 2) and shape(300_000, 64)[1] == 3
