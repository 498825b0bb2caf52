"""Hash tree: the law, sizes, slots, proportions, and which rows move when weights change."""

import math
import zlib

from kpiforge.llm.sharding import Shard, grid, grow, place, shard_of
from pyspark.sql import functions as F


def test_contract_on_odd_rows(make_docs):
    docs = [(i, f"text é {i}") for i in range(400)] + [(7, "text"), (7, "text"), (8, None), (9, ""), (None, "x"), (None, None)]
    out = place(make_docs(docs), grid(16)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    shard = {}
    slots = {}
    for r in out:
        assert shard.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_same_for_any_partitioning(make_docs):
    docs = make_docs([(i, str(i)) for i in range(200)])
    a, b = (dict(place(d, grid(16)).select("doc_id", "shard").collect()) for d in (docs.repartition(7), docs.coalesce(1)))
    assert a == b


def test_empty_table(make_docs):
    assert place(make_docs([]), grid(16)).collect() == []


def test_draw_by_hand(spark):
    """The descent recomputed in Python from Spark's 64-bit hashes."""
    topology = [Shard("a", "a1", 0, 1.0), Shard("a", "a1", 1, 3.0), Shard("a", "a2", 2, 2.0), Shard("b", "b1", 3, 2.0)]
    names = ["/a", "/b", "a/a1", "a/a2", "a/a1/0", "a/a1/1"]
    keys = spark.range(300)
    rows = keys.select("id", shard_of(F.col("id"), topology).alias("s"), *[
        F.xxhash64(F.lit(n), F.col("id")).alias(f"h{k}") for k, n in enumerate(names)]).collect()

    def draw(h, w):
        return -math.log((((h & (2**64 - 1)) >> 11) + 0.5) / 2**53) / w

    for r in rows:
        h = {n: r[f"h{k}"] for k, n in enumerate(names)}
        if draw(h["/b"], 2) < draw(h["/a"], 6):
            want = 3
        elif draw(h["a/a2"], 2) < draw(h["a/a1"], 4):
            want = 2
        else:
            want = 0 if draw(h["a/a1/0"], 1) < draw(h["a/a1/1"], 3) else 1
        assert r["s"] == want


def test_proportions_and_confined_movement(spark):
    base = [Shard("a", "a1", 0), Shard("a", "a1", 1), Shard("a", "a2", 2, 2.0), Shard("b", "b1", 3), Shard("b", "b2", 4, 3.0)]
    more = [s if s.shard != 1 else Shard("a", "a1", 1, 4.0) for s in base]
    rows = spark.range(40000).select(shard_of(F.col("id"), base).alias("x"), shard_of(F.col("id"), more).alias("y"),
                                     shard_of(F.col("id"), grow(base)).alias("z")).collect()
    share = {s.shard: s.weight / 8 for s in base}
    for k, p in share.items():
        assert abs(sum(r["x"] == k for r in rows) / len(rows) - p) < 0.012
    # only region a, and in it only rack a1, gained weight: nothing moves between other subtrees
    for r in rows:
        if r["x"] != r["y"]:
            assert r["y"] in (0, 1) or (r["x"] in (3, 4) and r["y"] == 2) or (r["x"] == 0 and r["y"] == 1)
        assert r["z"] in (r["x"], 5)
    assert not any(r["x"] == 2 and r["y"] in (3, 4) for r in rows) and not any(r["x"] == 3 and r["y"] == 4 for r in rows)
