"""Toxicity: the contract's columns and folds, held-out accuracy, and what the counterfactual penalty buys."""

import random
import zlib

import numpy as np
import pytest

from kpiforge.llm import toxicity
from kpiforge.llm.toxicity import fit, fit_logistic, logits, score


@pytest.fixture
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=500, seed=1):
    """Toxic texts insult; in the sample they also name one group more often than others do."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Scum", "trash"])
        if rng.random() < (0.6 if bad else 0.1):
            words[rng.randrange(len(words))] = "muslim"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_contract(make_docs, make_labels):
    docs, labels = corpus()
    docs += [(10_000, None), (10_001, ""), (None, "idiot w1 w2"), (3, docs[3][1])]
    out = score(make_docs(docs), fit(make_docs(docs), make_labels(labels))).collect()
    assert len(out) == len(docs)
    truth = {i: t for i, _, t in labels}
    test = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.93
    empty = {r["score"] for r in out if r["doc_id"] in (10_000, 10_001)}
    assert len(empty) == 1


def test_rows_that_repeat_an_id_are_learned_from_once(make_docs, make_labels):
    docs, labels = corpus(200)
    one = next(d for d, (i, _, t) in zip(docs, labels) if t and not held(i))
    once, often = (fit(make_docs(d), make_labels(labels)) for d in (docs, docs + [one] * 50))
    assert all(np.array_equal(a, b) for a, b in zip(once, often))


def test_labels_of_held_out_rows_change_nothing(make_docs, make_labels):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in score(make_docs(docs), fit(make_docs(docs), make_labels(x))).collect()) for x in (labels, flipped))
    assert a == b


def test_penalty_lowers_the_score_of_neutral_mentions(make_docs, make_labels):
    import pyarrow as pa
    docs, labels = corpus(600, 2)
    neutral = pa.array(["a muslim family moved in", "a christian family moved in", "w1 w2 idiot"])
    gap = {}
    for penalty in (0.0, 1.0):
        model = fit(make_docs(docs), make_labels(labels), penalty=penalty)
        a, b, insult = logits(neutral, *model)
        gap[penalty] = abs(a - b)
        assert insult > 0
    assert gap[1.0] < 0.25 * gap[0.0]


@pytest.mark.parametrize("named,other", [("muslim", "christian"), ("musulmans", "juifs"), ("einwanderer", "ausländer"), ("inmigrantes", "extranjeros")])
def test_penalty_acts_in_every_language(named, other):
    """English, French, German, Spanish: texts that name one group more often when toxic; a neutral mention of it scores like
    that of another group."""
    import pyarrow as pa
    docs, labels = corpus(600, 3)
    texts = pa.array([t.replace("muslim", named) for _, t in docs])
    toxic, gap = np.array([x[2] == 1 for x in labels]), {}
    for penalty in (0.0, 1.0):
        a, b, insult = logits(pa.array([f"w1 {named} w2", f"w1 {other} w2", "w1 w2 idiot"]), *toxicity.train(texts, toxic, 0.3, penalty))
        gap[penalty] = abs(a - b)
        assert insult > 0
    assert gap[0.0] > 0.5 and gap[1.0] < 0.25 * gap[0.0]


def test_gradient_step_matches_differences():
    """The penalised loss falls to a point where its numeric gradient is near zero."""
    rng = np.random.default_rng(0)
    rows, cols = np.repeat(np.arange(40), 3), rng.integers(0, 6, 120)
    once = np.unique(rows * 6 + cols)
    rows, cols = once // 6, once % 6
    y = (rng.random(40) < 0.5).astype(float)
    changes = [(np.array([0, 1]), np.array([-1.0, 1.0]))]
    w, b = fit_logistic(rows, cols, y, 6, changes, penalty=0.5, ridge=1e-3, steps=4000)

    def loss(v):
        z = v[-1] + np.bincount(rows, weights=v[cols], minlength=40)
        move = (v[changes[0][0]] * changes[0][1]).sum()
        return np.mean(np.logaddexp(0, z) - y * z) + 1e-4 / 2 * (v[:-1] ** 2).sum() + 0.5 * move ** 2

    v = np.append(w, b)
    g = [(loss(v + 1e-5 * e) - loss(v - 1e-5 * e)) / 2e-5 for e in np.eye(7)]
    assert np.abs(g).max() < 1e-2 and abs(w[0] - w[1]) < 0.2


def test_one_label_or_none(make_docs, make_labels):
    docs, _ = corpus(20)
    for labels, share in ([], 0.0), ([(i, 1, 0) for i, _ in docs], 0.0), ([(i, 1, 1) for i, _ in docs], 1.0):
        out = score(make_docs(docs), fit(make_docs(docs), make_labels(labels))).collect()
        assert len(out) == 20 and all(abs(r["score"] - share) < 1e-6 for r in out)
    assert score(make_docs([]), fit(make_docs([]), make_labels([(1, 1, 1), (2, 1, 0)]))).collect() == []
    assert toxicity.fit(make_docs([]), make_labels([]))[0].size == 0
