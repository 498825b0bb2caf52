"""Language identification: gradients against differences, folds, held-out accuracy, odd texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kpiforge.llm.common import byte_view
from kpiforge.llm.langid import ByteGRU, Reader, fit, pieces, predict


def test_backpropagation_matches_differences():
    net = ByteGRU(3, hidden=5, embed=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, label = np.array([[97, 98, 99, 100], [101, 102, 0, 0]]), np.array([0, 2])
    on = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)

    def loss():
        q = net.probabilities(words, on)
        return -sum(np.log(q[i, t, label[i]]) for i in range(2) for t in range(4) if on[i, t]) / on.sum()

    g = net.gradients(words, on, label)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(6):
            at = (rng.choice([97, 100, 101]), rng.integers(4)) if name == "e" else tuple(rng.integers(s) for s in value.shape)
            keep = value[at]
            value[at] = keep + 1e-3
            up = loss()
            value[at] = keep - 1e-3
            down = loss()
            value[at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), name


def corpus(spark, n=160):
    rng = random.Random(1)
    parts = {"aa": ["tha", "ing", "ou", "er"], "bb": ["çé", "eau", "oi", "ê"], "cc": ["sch", "ß", "ung", "ü"]}
    docs = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))), lang))
    docs += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 345 !!", "cc"), (None, docs[0][1], None), (5, docs[5][1], docs[5][2]),
             (1003, "schungß" * 40_000, None), (1004, "tha " * 100_000, None)]
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, held_out int, score string"), docs


def test_held_out_accuracy_and_contract(spark):
    df, docs = corpus(spark)
    out = predict(df, fit(df, steps=250)).collect()
    assert len(out) == len(docs)
    truth = {d: g for d, _, g in docs[:160]}
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    test = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in test]) > 0.95
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1003, 1004)} == {1003: "cc", 1004: "aa"}


def test_rows_that_repeat_an_id_are_learned_from_once(spark):
    df, docs = corpus(spark, 40)
    learned = next(d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1)
    again = spark.createDataFrame([(*learned, 1, "x")] * 50, df.schema)
    (names, once), (_, often) = fit(df, steps=20), fit(df.unionByName(again), steps=20)
    assert names == ["aa", "bb", "cc"] and all((once.p[k] == often.p[k]).all() for k in once.p)


def test_nothing_to_learn_from(spark):
    df, docs = corpus(spark, 6)
    none = df.withColumn("lang", df.lang.cast("string")).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in predict(none, fit(none)).collect()} == {"und"}
    empty = df.limit(0)
    assert predict(empty, fit(empty)).collect() == []


def test_document_is_the_mean_over_all_positions():
    """Every position of a text counts once, with the network's own distributions where a text is one piece."""
    net = ByteGRU(3, hidden=6, seed=2)
    texts = ["alpha beta  gamma é", "", "x", "ü" * 300, "one two " * 40]
    data, bounds = byte_view(pa.array(texts))
    row, first, last, low, high = pieces(data, bounds, piece=1000)
    assert row.tolist() == [0, 2, 3, 4] and (low == first).all() and (high == last).all()
    got = Reader(net, 3).sums(data, low, high, first, last)
    for k, t in zip(range(len(row)), (texts[0], texts[2], texts[3], texts[4])):
        raw = np.frombuffer(t.encode(), np.uint8)[None]
        assert np.allclose(got[k], net.probabilities(raw, np.ones(raw.shape, bool))[0].sum(0), atol=1e-3)


def test_pieces_hold_whole_characters_and_cover_a_text_once():
    texts = ["aé😀" * 200, "plain " * 100, "", "😀"]
    data, bounds = byte_view(pa.array(texts))
    row, first, last, low, high = pieces(data, bounds, piece=64, context=10)
    for r, t in enumerate(texts):
        own = np.flatnonzero(row == r)
        raw = t.encode()
        cut = [bytes(data[first[k]: last[k]]) for k in own]
        assert b"".join(cut) == raw
        for k in own:
            bytes(data[first[k]: last[k]]).decode(), bytes(data[low[k]: high[k]]).decode()  # never inside a character
            assert bounds[r] <= low[k] <= first[k] <= last[k] <= high[k] <= bounds[r + 1] and first[k] - low[k] <= 10


def test_long_texts_read_alike_in_pieces():
    """State from outside a piece reaches into it: the sums hardly depend on where a text is cut."""
    net = ByteGRU(3, seed=3)
    text = pa.array([" ".join(f"w{i % 13}ord{i % 7}" for i in range(600))])
    data, bounds = byte_view(text)
    sums = {}
    for piece in (64, 448, 10 ** 6):
        row, first, last, low, high = pieces(data, bounds, piece)
        sums[piece] = Reader(net, 3).sums(data, low, high, first, last).sum(0) / len(data)
    assert np.allclose(sums[64], sums[10 ** 6], atol=5e-3) and np.allclose(sums[448], sums[10 ** 6], atol=1e-3)


def test_neighbouring_words_tell_languages_apart(spark):
    """Both languages have the same words in the same numbers; only which follows which differs."""
    rng = random.Random(4)
    docs = []
    for i in range(240):
        pairs = [("ab", "cd"), ("ef", "gh")] if i % 2 else [("ab", "gh"), ("ef", "cd")]
        docs.append((i, " ".join(" ".join(rng.choice(pairs)) + " mm mm" for _ in range(40)), "xx" if i % 2 else "yy"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = [r for r in predict(df, fit(df, steps=300)).collect() if r["held_out"]]
    assert len(out) > 60 and np.mean([(r["lang_pred"] == "xx") == (r["doc_id"] % 2 == 1) for r in out]) > 0.95
