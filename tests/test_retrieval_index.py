"""Retrieval by score bounds, and an index kept by updates, against the plain index."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from kpiforge.operators.retrieval import fit_tfidf, retrieve
from kpiforge.operators.retrieval_bounds import bounded_index, search, share_read
from kpiforge.operators.retrieval_store import TfidfStore
from kpiforge.sources.tables import read_table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(rng, n, words=40):
    return [(k, " ".join(rng.choice("abcdefghij") * rng.randint(1, words // 10) for _ in range(rng.randint(0, 30)))) for k in range(n)]


def test_bounded_search_gives_the_same_rows(spark):
    rng = random.Random(7)
    docs = corpus(rng, 300) + [(1000 + k, "a bb ccc") for k in range(60)]  # ties beyond k
    queries = corpus(rng, 25) + [(90, ""), (91, "zzzzz"), (92, "a bb ccc"), (93, docs[4][1])]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "qid long, text string")
    index = fit_tfidf(d)
    for block, ks in ((4, (1, 5, 70)), (10 ** 6, (5,))):
        bounded = bounded_index(index, block)
        for k in ks:
            assert rows(search(bounded, q, k).result.select("qid", "doc_id", "score", "rank")) == rows(retrieve(index, q, k))


def test_bounded_search_reads_a_part_of_the_postings(spark):
    docs, items = read_table(spark, SF_CHECK, "documents"), read_table(spark, SF_CHECK, "benchmark")
    index = fit_tfidf(docs, "doc_id", "text")
    bounded = bounded_index(index)
    for k, share in ((1, 0.25), (3, 0.4)):
        s = search(bounded, items, k, "item_id", "text")
        read = share_read(s).first()
        assert 0 < read["read"] < share * read["postings"]
        assert rows(s.result.select("qid", "doc_id", "score", "rank")) == rows(retrieve(index, items, k, "item_id", "text"))


def test_updates_equal_one_fit(spark, tmp_path):
    rng = random.Random(3)
    q = spark.createDataFrame(corpus(rng, 12), "qid long, text string")

    def frame(docs):
        return spark.createDataFrame(docs, "id long, text string")

    def check(docs):
        index, whole = store.index(), fit_tfidf(frame(docs))
        assert rows(index.docs.select("doc_id")) == rows(whole.docs.select("doc_id"))
        assert [(t, round(i, 12)) for t, i in rows(index.idf.select("tok", "idf"))] == [(t, round(i, 12)) for t, i in rows(whole.idf.select("tok", "idf"))]
        assert rows(retrieve(index, q, 8)) == rows(retrieve(whole, q, 8))

    store = TfidfStore(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        store.update(delete=frame([(1, "")]))
    first = corpus(rng, 60)
    store.update(frame(first + [(3, "zz smaller text is kept"), (5, None)]))
    kept = dict(first)
    kept[3] = min(kept[3], "zz smaller text is kept")
    check(list(kept.items()))
    second = [(k + 50, t) for k, t in corpus(rng, 30)]  # some replace, some are new
    store.update(frame(second), frame([(2, ""), (55, ""), (999, "")]))  # 55 is deleted and comes again
    kept.update(second)
    kept.pop(2)
    check(list(kept.items()))
    store.update(delete=frame([(k, "") for k in range(10, 70)]))
    kept = {k: t for k, t in kept.items() if not 10 <= k < 70}
    check(list(kept.items()))
    store.update(frame([(2, "back again"), (12, "a bb")]))
    kept.update({2: "back again", 12: "a bb"})
    check(list(kept.items()))
    assert store.version == 3


def test_all_documents_deleted(spark, tmp_path):
    store = TfidfStore(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    store.update(docs)
    store.update(delete=docs)
    assert retrieve(store.index(), spark.createDataFrame([(1, "a b")], "qid long, text string"), 3).collect() == []
    assert rows(store.index(0).idf.select("tok")) == [("a",), ("a_b",), ("b",), ("b_c",), ("c",)]


def test_blocks_of_documents_and_queries_give_the_exact_list(spark, monkeypatch):
    """No row for each (query, document) pair is made: no aggregate by both is left in the plan."""
    import math
    import re
    from collections import Counter

    from kpiforge.operators import retrieval, retrieval_blocks

    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 5)
    rng = random.Random(11)
    docs = corpus(rng, 150) + [(500 + k, "a bb ccc") for k in range(30)] + [(900, None)]
    asked = corpus(rng, 17) + [(90, "a bb ccc"), (91, "zzzzz"), (92, "")]
    index = fit_tfidf(spark.createDataFrame(docs, "id long, text string"))
    found = retrieve(index, spark.createDataFrame(asked, "qid long, text string"), 7)
    assert "HashAggregate" not in found._jdf.queryExecution().toString()

    def tokens(text):
        u = re.findall("[a-z0-9_]+", text or "")
        return Counter(u + [f"{a}_{b}" for a, b in zip(u, u[1:])])

    of = {d: tokens(t) for d, t in docs}
    df = Counter(t for c in of.values() for t in c)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    units, want = {d: unit(c) for d, c in of.items()}, []
    for q, text in asked:
        v = unit(tokens(text))
        scored = sorted((-round(sum(x * u[t] for t, x in v.items() if t in u), 7), d) for d, u in units.items() if set(u) & set(v))
        want += [(q, d, -s, r) for r, (s, d) in enumerate(scored[:7], 1)]
    got = rows(found.select("qid", "doc_id", "score", "rank"))
    assert [(q, r) for q, _, _, r in got] == [(q, r) for q, _, _, r in sorted(want)] and {x[:2] for x in got} == {x[:2] for x in want}
    assert all(abs(a[2] - b[2]) < 2e-7 for a, b in zip(got, sorted(want)))
    assert retrieval_blocks.CHUNK_DOCS > 16


def test_long_and_repeated_texts_are_packed_exactly(spark, monkeypatch):
    """Documents over several blocks of terms, with counts and numbers of one, two and four bytes."""
    import numpy as np

    from kpiforge.operators import retrieval_blocks as blocks

    for x in ([0, 255], [256, 3], [70000, 1]):
        sizes = np.array([1, 1])
        assert blocks._wide(blocks._narrow(np.array(x)).tobytes(), sizes).tolist() == x
    docs = [(1, "a " * 70000 + "b"), (2, "a b " * 200), (3, "b c"), (4, None), (5, "...")]
    index = fit_tfidf(spark.createDataFrame(docs, "id long, text string"))
    tf = {(r["doc_id"], r["tok"]): r["tf"] for r in index.terms.collect()}
    assert tf[1, "a"] == 70000 / 140001 and tf[1, "a_b"] == 1 / 140001 and tf[2, "b_a"] == 199 / 799
    norm = dict(rows(index.docs.select("doc_id", "norm")))
    idf = dict(rows(index.idf.select("tok", "idf")))
    for d in range(1, 6):
        want = sum((x * idf[t]) ** 2 for (k, t), x in tf.items() if k == d) ** 0.5
        assert abs(norm[d] - want) < 1e-12


def written(monkeypatch, *modules):
    """The tables that are written to the shared folder from here on: ``{name: (columns, physical plan)}``."""
    from kpiforge.sources.tables import shared_table

    seen = {}

    def noted(df, name, *args, **options):
        seen[name] = df.columns, df._jdf.queryExecution().executedPlan().toString()
        return shared_table(df, name, *args, **options)

    for module in modules:
        monkeypatch.setattr(module, "shared_table", noted)
    return seen


def test_blocks_meet_where_they_lie(spark, monkeypatch):
    """followup_retrieval: documents and queries are not dealt once more for each block of the others."""
    from kpiforge.operators import retrieval

    rng = random.Random(5)
    index = fit_tfidf(spark.createDataFrame(corpus(rng, 80), "id long, text string"))
    asked = spark.createDataFrame(corpus(rng, 30), "qid long, text string")
    want = rows(retrieve(index, asked, 4))
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    seen = written(monkeypatch, retrieval)
    assert rows(retrieve(index, asked, 4)) == want
    assert "hashpartitioning" not in seen["best-of-blocks"][1]


def test_terms_are_not_written_as_rows(spark, monkeypatch, tmp_path):
    """tfidf_updated, tfidf_topk: what is stored and moved are a block's words and its distinct tokens, not a row for each term."""
    from kpiforge.operators import retrieval, retrieval_store

    seen = written(monkeypatch, retrieval, retrieval_store)
    docs = spark.createDataFrame(corpus(random.Random(2), 50), "id long, text string")
    store = TfidfStore(spark, str(tmp_path / "index"))
    store.update(docs)
    store.update(docs.where("id < 20"), docs.where("id > 40"))
    assert spark.read.parquet(str(tmp_path / "index/terms")).count() < 20
    for index in (store.index(), fit_tfidf(docs)):
        rows(retrieve(index, docs.toDF("qid", "text"), 3))
    assert seen and not [name for name, (columns, _) in seen.items() if "tok" in columns]


def test_words_and_terms_are_those_of_the_pattern(spark):
    """Texts that touch in memory, several blocks of a task, words that read like pairs, other letters, null and empty texts, null ids."""
    import re
    from collections import Counter

    from kpiforge.operators import retrieval, retrieval_blocks as blocks

    rng = random.Random(9)
    docs = [(k, "".join(rng.choice("ab_ é9-Z") for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, "a_b a b a_b"), (503, "_"), (504, "ab"), (505, "ab " * 400), (None, "a b c")]
    df = spark.createDataFrame(docs, "id long, text string").coalesce(1)

    def tokens(text):
        u = re.findall("[a-z0-9_]+", (text or "").lower())
        return Counter(u + [f"{a}_{b}" for a, b in zip(u, u[1:])])

    want = sorted(((d, t, n, sum(c.values())) for d, text in docs for c in [tokens(text)] for t, n in c.items()), key=repr)
    size = {"CHARS": 4096}

    def small(batches):
        blocks.CHARS, before = size["CHARS"], blocks.CHARS
        yield from blocks.pack_words(7 << 44)(batches)
        blocks.CHARS = before

    one = df.select("id", F.lower("text"))
    packed = one.mapInArrow(lambda b: small(b), blocks.blocks_schema("bigint"))
    kept = packed.collect()
    assert len(kept) > 3 and [r["block"] for r in kept] == [(7 << 44) + k for k in range(len(kept))] and sum(len(r["ids"]) for r in kept) == len(docs)
    assert sorted(map(tuple, retrieval.block_terms(packed).collect()), key=repr) == want
    dealt = packed.mapInArrow(blocks.deal_tokens(5), blocks.DEALT)
    frequencies = dealt.groupBy("bucket").applyInArrow(lambda t: blocks.count_bucket(False)(t), blocks.DEALT)
    assert dict(frequencies.mapInArrow(blocks.list_tokens, "tok string, df long").collect()) == Counter(t for _, t, _, _ in want)
    assert not frequencies.where("bucket < 0 OR bucket > 4").count()


def test_few_and_many_repeated_ids(spark):
    from kpiforge.operators.retrieval import one_per_id

    docs = [(k, f"t{k}") for k in range(100)] + [(None, "z"), (None, "y")]
    for more in ([], [(3, "a"), (3, None)], [(k, "a") for k in range(50)]):
        got = one_per_id(spark.createDataFrame(docs + more, "i long, x string"), "i", "x")
        want = {}
        for i, t in docs + more:
            want[i] = t if want.get(i) is None else min(want[i], t) if t is not None else want[i]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.items(), key=repr)


def test_a_prompt_part_holds_each_text_once(spark, monkeypatch):
    """chat_context: many prompts name the same documents; texts do not move once for each prompt."""
    from kpiforge.operators import retrieval

    seen = written(monkeypatch, retrieval)
    docs = [(k, f"text {k} " + "x" * 500) for k in range(6)] + [(7, None), (8, "twice b"), (8, "twice a")]
    ranked = [(q, d, p) for q in range(300) for p, d in enumerate([q % 3, 5, 8], 1)] + [(900, 7, 1), (901, 77, 1), (902, 1, 9)]
    summaries = [(0, "hello"), (5, ""), (950, "alone"), (951, None), (900, "no text")]
    text = {**dict(docs), 8: "twice a"}
    facts = {q: [text[d] for _, d in sorted((p, d) for a, d, p in ranked if a == q and p <= 6 and d in text)] for q in {r[0] for r in ranked}}
    want = {}
    for q in {q for q, f in facts.items() if f} | {q for q, _ in summaries}:
        head = ["[Recent conversation]\n" + dict(summaries)[q]] if dict(summaries).get(q) else []
        lines = "\n".join("  - " + t for t in facts.get(q, []) if t is not None)
        want[q] = "\n".join(head + (["\n[Verified data facts from dashboard]\n" + lines] if facts.get(q) else []))
    frames = (spark.createDataFrame(ranked, "qid long, doc_id long, position long"), spark.createDataFrame(docs, "id long, text string"))
    chat = spark.createDataFrame(summaries, "qid long, summary string")
    for part in (1 << 27, 5000):
        monkeypatch.setattr(retrieval, "PART", part, raising=False)
        out = retrieval.context_block(*frames, summaries=chat)
        assert dict(map(tuple, out.collect())) == want
        assert "hashpartitioning(qid" not in out._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, retrieval.context_block(*frames).collect())) == {
        q: "\n[Verified data facts from dashboard]\n" + "\n".join("  - " + t for t in f if t is not None) for q, f in facts.items() if f}
    assert seen["context-lists"][0] == ["qid", "head", "docs", "n"]
