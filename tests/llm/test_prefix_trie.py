"""Prefix trie: every node against plain Python, with full and starved sketches, long and hot conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kpiforge.llm import prefix_trie, queries
from kpiforge.llm.prefix_trie import _chained, _power, trie
from kpiforge.sources.tables import read_table

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string, kind int, part int, pos long"


def rem(c, n):
    return c - int(c / n) * n if abs(c) < 2 ** 50 else (abs(c) % n) * (1 if c > 0 else -1)


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - rem(c, 5), [])[:h] + own[h:])
    members, children = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            if d:
                children.setdefault(seq[: d - 1], set()).add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, ids in members.items():
        end = ",".join(str(c) for c in sorted(c for c in ids if len(built[c]) == len(node)))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, ())), leaves[node], saved[node],
                    hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "x", 7, 8, 9) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in trie(df, **k).collect()) == expected(rows)


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            # shared openings: few texts early, many later
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", f"text {rng.randint(0, 1 + 4 ** min(t, 6))} é"))
    return rows


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


@pytest.mark.parametrize("cells", [8, 256, 1 << 20])
def test_sketch_of_any_size(spark, cells):
    """A sketch too small to prove anything gives the same nodes as one that proves all."""
    check(spark, corpus(1), most_cells=cells)


def test_cases(spark):
    check(spark, [])
    check(spark, [(None, 0, "user", "x")])
    check(spark, [(3, None, None, None)])
    rows = corpus(2, 40)
    rows += [(50, None, "user", "no turn"), (50, 0, None, "no role"), (50, 1, "user", None), (50, 1, "user", ""), (51, 0, "user", "tie"),
             (51, 0, "user", "tie"), (52, 2, "b", "x"), (52, 2, "a", "y"), (None, 1, "user", "lost"), (-3, 0, "user", "negative"), (-5, 0, "user", "n"),
             (2 ** 62 + 1, 5, "user", "large " * 5000), (-2 ** 63, 0, "", "least"), (2 ** 63 - 1, 0, "user", "most")]
    rng = random.Random(3)
    rng.shuffle(rows)
    check(spark, rows)


def test_long_and_hot_conversations(spark):
    """Conversations that cross many ranges; copies of one, to its end, under many ids."""
    rows = [(7, t, "user", f"turn {t % 11}") for t in range(3000)] + [(12, t, "user", f"turn {t % 11}") for t in range(1700)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 4600) for t in range(2)]
    rows += [(20, t, "user", "again") for t in range(800)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, rows)
        check(spark, rows, most_cells=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_first_conversation_left_without_turns(spark):
    """A conversation whose own turns are all replaced by those of one that does not exist ends at the root."""
    ids = [c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:20]
    check(spark, [(c, t, "user", f"{c}") for c in ids for t in range(2)])


def test_chained_digests():
    rng = np.random.default_rng(2)
    base, t = prefix_trie._BASES[0], rng.integers(0, 2 ** 63, 50).astype(np.uint64)
    first = np.repeat([0, 20], [20, 30])
    got, p = _chained(base, t, first, 77, 20), 77
    for k in range(50):
        p = ((0 if k == 20 else p) * base + int(t[k])) % 2 ** 64
        assert int(got[k]) == p
    assert [int(x) for x in _power(base, np.array([0, 1, 2, 63, 1000]))] == [pow(base, e, 2 ** 64) for e in (0, 1, 2, 63, 1000)]
