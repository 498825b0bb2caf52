"""Shared helpers: word runs and hashes against plain Python, components on awkward graphs, tables in the shared folder."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge.llm.common import FOLDED, byte_view, components, hash_slices, ngram_hashes, slices, stored, word_spans


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\t\n\x0b中.", max_size=12)), max_size=8))
def test_words_and_hashes(texts):
    col = pa.array(texts, pa.string())
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    got = {}
    seen = [[] for _ in texts]
    for first, n, hashes, rows in hash_slices(col, FOLDED, most=7):
        for h, r in zip(hashes.tolist(), rows.tolist()):
            seen[first + r].append(h)
    for own, hashes in zip(words, seen):
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes):
            assert got.setdefault(h, w) == w  # one hash, one word
    assert len(set(got)) == len({w for own in words for w in own})


def test_slices_and_sliced_columns():
    col = pa.array(["ab c", None, "", "d" * 50, "e f"], pa.string())
    data, bounds = byte_view(col.slice(1, 4))
    assert data.tobytes() == b"d" * 50 + b"e f" and bounds.tolist() == [0, 0, 0, 50, 53]
    assert list(slices(bounds, 10)) == [(0, 2), (2, 3), (3, 4)] and list(slices(np.zeros(1, np.int64))) == []
    starts, ends, rows = word_spans(data, bounds, FOLDED[0])
    assert [(s, e, r) for s, e, r in zip(starts, ends, rows)] == [(0, 50, 2), (50, 51, 3), (52, 53, 3)]


def test_order_of_words_counts():
    w = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    assert len(set(ngram_hashes(w, 2).tolist())) == 5 and len(ngram_hashes(w, 7)) == 0
    assert ngram_hashes(w[:2], 2)[0] != ngram_hashes(w[:2][::-1].copy(), 2)[0]


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    order = list(range(120))
    rng.shuffle(order)
    edges = {"chain": list(zip(order, order[1:])), "star": [(50, k) for k in range(120)], "none": [], "loops": [(3, 3), (4, 5), (5, 4)],
             "random": [(rng.randrange(-100, 100), rng.randrange(-100, 100)) for _ in range(110)]}[kind]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_stored_is_read_back_from_the_shared_folder(spark):
    df = stored(spark.range(5).selectExpr("id", "cast(null as string) AS text"), "test")
    assert df.dtypes == [("id", "bigint"), ("text", "string")] and df.count() == 5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert df.inputFiles() and all(folder in f for f in df.inputFiles())
