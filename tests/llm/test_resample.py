"""Importance resampling: counts and weights against plain Python, the draw, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import resample


def tokens(t):
    return re.findall(r"[\w\u0080-\U0010ffff]+|[!-/:-@\[-^`{-~]+", t or "", re.A)


def corpus(n=300, seed=1, vocabulary=40):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20, 60))]
        docs.append((i, " ".join(w + "$$$" if bad else w for w in words)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels


@pytest.fixture
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_weights_equal_plain_counts(make_docs, make_labels):
    docs, labels = corpus(80, vocabulary=6)  # so few n-grams that no two share a bucket
    docs += [(1000, None), (1001, "")]
    ratio, sample = resample.fit(make_docs(docs), make_labels(labels))
    got = {r["doc_id"]: r for r in resample.score(make_docs(docs), ratio, sample).collect()}
    good = {i for i, q, _ in labels if q == 1}

    def grams(t):
        w = tokens(t)
        return Counter(w) + Counter(zip(w, w[1:]))

    raw, target = Counter(), Counter()
    for i, t in docs:
        raw += grams(t)
        if i in good:
            target += grams(t)
    share = sum(target.values()) / sum(raw.values())
    for i, t in docs:
        want = sum(n * math.log((target[g] + 3) / (raw[g] * share + 3)) for g, n in grams(t).items())
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-3), i
        assert got[i]["n_grams"] == sum(grams(t).values())


def test_poor_documents_go_and_good_stay(make_docs, make_labels):
    docs, labels = corpus()
    kept = {r["doc_id"] for r in resample.resample(make_docs(docs), make_labels(labels)).collect()}
    poor = {i for i, _ in docs if i % 5 == 0}
    assert not kept & poor and len({i for i, _ in docs} - poor - kept) <= 3
    rows = resample.keep(make_docs(docs), make_labels(labels))
    assert {r["doc_id"] for r in rows.collect()} == kept and rows.columns == make_docs(docs).columns


def test_labels_missing_conflicting_or_null(make_docs, make_labels):
    docs, labels = corpus(40)
    docs += [(None, "w1 w2 w3"), (None, None), (3, docs[3][1])]
    n = len(docs)
    assert resample.resample(make_docs(docs), make_labels([])).count() == n  # nothing to aim at: all weights 0, all kept
    assert resample.resample(make_docs(docs), make_labels([r for r in labels if r[1] == 1])).count() == n
    both = labels + [(i, 0, 0) for i, q, _ in labels[:2]] + [(None, 1, 0), (7, None, 0)]
    assert 0 < resample.resample(make_docs(docs), make_labels(both)).count() <= n
    assert resample.resample(make_docs([]), make_labels(labels)).count() == 0
    assert resample.keep(make_docs([]), make_labels([])).count() == 0


def test_gumbel_noise_is_gumbel(spark):
    g = np.array([r[0] for r in spark.range(20000).select(resample.gumbel(F.col("id"), 3)).collect()])
    assert abs(g.mean() - 0.5772) < 0.04 and abs(g.var() - math.pi ** 2 / 6) < 0.08


def test_best_cut():
    w, g = np.array([3.0, -2.0, 1.0, -5.0, 0.0]), np.array([True, False, True, False, True])
    assert -2 < resample.best_cut(w, g) < 0
    assert resample.best_cut(w, np.ones(5, bool)) == -np.inf
    assert resample.best_cut(np.array([1.0, 1.0]), np.array([True, False])) in (-np.inf, np.inf)


@pytest.mark.parametrize("k", [1, 2, 57, 499, 500, 800])
def test_kth_largest(spark, k):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 5), 1.25]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values, reverse=True)[k - 1] if k < 500 else -math.inf
    assert resample.kth_largest(df, "v", k, bins=8, settle=5) == want
