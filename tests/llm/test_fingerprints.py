"""Fingerprints: edited texts, sketches and likeness against plain Python; peeling and growing; rows that repeat."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kpiforge.llm import fingerprints as fp
from kpiforge.llm import queries
from kpiforge.sources.tables import read_table

PARAGRAPH = re.compile(fp.PARAGRAPH)


def digests(text):
    return {int(hashlib.sha256(p.encode()).hexdigest()[:15], 16) for p in PARAGRAPH.findall(text)}


def sketch(digest_set):
    cells = [[0, 0, 0] for _ in range(3 << fp.WIDTH)]
    for k in digest_set:
        for i in range(3):
            c = cells[(i << fp.WIDTH) + ((k >> (fp.WIDTH * i)) & ((1 << fp.WIDTH) - 1))]
            c[0] += 1
            c[1] ^= k
            c[2] ^= (k % 1000000007) * (k % 998244353) % 2147483647
    return " ".join(".".join(f"{v:x}" for v in c) for c in cells)


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """``rows``: (doc_id, text) in the order of documents."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text)
        changed = text[: n - n // 2] + after[: n // 2]
        a, e, x = digests(text), digests(changed), digests(after)
        out.append((doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), sketch(a), sketch(e), alike(a, e), alike(a, x)))
    return out


def compare(got, want):
    def key(r):
        return str(r[:5])

    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(g[k] - w[k]) < 1e-12 for g, w in zip(got, want) for k in (5, 6))


def in_order(rows):
    key = [(d is None, 0 if d is None else -d, hashlib.sha256(f"{'null' if d is None else d}:{t or ''}".encode()).digest()[:16]) for d, t in rows]
    return [(d, t or "") for _, (d, t) in sorted(zip(key, rows), key=lambda p: p[0])]


def test_given_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    compare(queries.op11_lookup_fingerprints(spark, sf).collect(), expected(in_order([tuple(r) for r in docs])))


def test_cases(spark, make_docs):
    rng = random.Random(4)
    long = "\n".join("".join(rng.choice("abc .é😀") for _ in range(rng.randint(1, 300))) for _ in range(400))
    rows = [(7, "one line"), (6, None), (5, ""), (4, long), (4, "other text of the same id.\nSecond."), (4, "same"), (4, "same"), (4, "same"),
            (None, "no id"), (None, None), (-3, "x" * 3000), (2 ** 62, "😀é\n\nü"), (-2 ** 63, "\n\n\n"), (2 ** 63 - 1, long[:20000])]
    compare(fp.fingerprints(make_docs(rows)).collect(), expected(in_order(rows)))
    assert fp.fingerprints(make_docs([])).collect() == []
    compare(fp.fingerprints(make_docs([(1, "alone. " * 60)])).collect(), expected([(1, "alone. " * 60)]))


def test_many_copies(spark, make_docs):
    rows = [(3, "a copy.\nof two lines")] * 300 + [(9, "first"), (1, "last")]
    compare(fp.fingerprints(make_docs(rows)).collect(), expected(in_order(rows)))


def test_differences_of_all_sizes(spark):
    """The smallest sketch recovers small differences, larger ones the rest, whatever the digests."""
    rng = random.Random(9)
    rows, want = [], []
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 200, 1500, 6000]:
        for common in (0, 10, 1000):
            pool = rng.sample(range(2 ** 60), n + common)
            cut = rng.randint(0, n)
            rows.append((pool[:cut] + pool[n:], pool[cut:n] + pool[n:][::-1]))
            want.append(n)
    rows.append(([64 * k for k in range(40)], []))  # same place in every row of the smallest sketches
    want.append(40)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<long>, b array<long>")
    df = df.withColumn("ca", F.expr(fp.sketch("a"))).withColumn("cb", F.expr(fp.sketch("b")))
    df = df.withColumn("small", F.expr(fp._peeled(fp.minus("ca", "cb"), str(fp.WIDTH)))).withColumn("d", F.expr(fp.difference("ca", "cb", "a", "b")))
    got = {r["k"]: r for r in df.collect()}
    assert [got[k]["d"] for k in range(len(rows))] == want
    assert any(r["small"] is None for r in got.values())
    for k, (a, b) in enumerate(rows):
        if got[k]["small"] is not None:
            assert {(x["k"], x["s"]) for x in got[k]["small"]} == {(x, 1) for x in set(a) - set(b)} | {(x, -1) for x in set(b) - set(a)}


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.op11_lookup_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
