"""Insights, facts, TF-IDF retrieval (against a brute-force numpy model), history."""

import re
from datetime import date

import numpy as np
import pytest

from conftest import line
from kpiforge.operators import facts, history, insights, retrieval


def rows(df):
    return [r.asDict() for r in df.collect()]


def trend(spark, values, start_year=2000):
    data = [(date(start_year + i, 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "period date, v double")


@pytest.mark.parametrize("values,growth,cagr,momentum", [
    ([5.0], None, None, None),
    ([0.0, 5.0], 0.0, 0.0, None),
    ([100.0, 121.0], 21.0, 21.0, None),
    ([1.0, 2.0, 3.0, 4.0], 300.0, pytest.approx(58.740105, abs=1e-6), pytest.approx(400 / 3)),
    ([10.0, 20.0, -5.0], -150.0, None, None),
])
def test_trend_short(spark, values, growth, cagr, momentum):
    r = rows(insights.trend_insights(trend(spark, values), "v", "year"))[0]
    assert r["n"] == len(values)
    assert r["growth_pct"] == (pytest.approx(growth) if growth is not None else None)
    assert r["cagr"] == cagr
    assert r["momentum_pct"] == momentum


def test_peak_ties_take_earliest_and_swing_guard(spark):
    r = rows(insights.trend_insights(trend(spark, [3.0, 7.0, 7.0, 1.0]), "v", "month"))[0]
    assert r["peak_period"] == date(2001, 1, 1) and r["trough_period"] == date(2003, 1, 1)
    assert r["swing_pct"] == pytest.approx(6 / 7 * 100)
    z = rows(insights.trend_insights(trend(spark, [0.0, -1.0]), "v", "month"))[0]
    assert z["swing_pct"] is None  # peak 0


def test_period_changes(spark):
    out = rows(insights.period_changes(trend(spark, [0.0, 10.0, 13.0, 12.0]), "v"))
    assert [r["change_pct"] for r in out][:2] == [None, None]
    assert out[2]["change_pct"] == pytest.approx(30.0) and out[2]["growth_class"] == "strong_growth"
    assert out[3]["growth_class"] == "decline" and out[1]["growth_class"] == "flat"


def test_rank_summary(spark):
    res = spark.createDataFrame([("a", 50.0), ("b", 20.0), ("c", 20.0), ("d", -10.0)], "breakdown string, profit double")
    r = rows(insights.rank_summary(res, "profit"))[0]
    assert r["leader"] == "a" and r["leader_share_pct"] == pytest.approx(62.5)
    assert r["leader_gap_pct"] == pytest.approx(60.0) and r["uneven"]
    assert r["top2_pct"] == pytest.approx(87.5) and r["concentrated"]
    assert r["loss_values"] == "d" and r["worst_loss"] == -10.0 and r["bottom"] == "d"


def test_value_insights(spark):
    k = spark.createDataFrame([(200.0, 50.0, 4)], "total_sales double, total_profit double, total_orders long")
    r = rows(insights.value_insights(k))[0]
    assert r["margin_class"] == "strong" and r["avg_order_value"] == 50.0 and r["vs_benchmark"] == "above"


def test_facts_text(make_lines):
    df = make_lines([line(1, "2016-03-05", region="East", sales="1234566.50", profit="-10.0000"),
                     line(2, "2017-03-05", region="West", sales="2.50", profit="3.0000", discount="0.35")])
    f = {r["chunk_id"]: r["text"] for r in facts.build_facts(df).collect()}
    assert f["kpi_summary"] == ("KPI summary (current filters): Total Sales=$1,234,569, Total Profit=$-7, "
                                "Total Orders=2, Profit Margin=-0.00%.")
    assert f["time_range"] == "Data spans 2016-03-05 to 2017-03-05. 2 years: [2016, 2017]. 2 months total."
    assert f["yearly_2017"] == "Year 2017: Sales=$2, Profit=$3, Orders=1, Margin=120.0%."
    assert f["monthly_worst_profit"] == "Worst month by profit: 2016-03 — $-10."
    assert f["dim_region"].startswith("Dimension 'region' values: ['East', 'West']. Detail: East: Sales=$1,234,566")
    assert f["discount_impact"] == ("Discount impact on profit: Discount 0-10%: avg profit=$-10, avg sales=$1,234,566 "
                                    "(1 orders); Discount >30%: avg profit=$3, avg sales=$2 (1 orders).")
    assert "schema_metrics" in f and f["filter_context"] == "Current dashboard filters: Date range: full history."


# ── TF-IDF against a brute-force dense model (the reference's definition) ──

def brute_force(docs, query):
    def tok(t):
        u = re.findall(r"[a-z0-9_]+", t.lower())
        return u + [f"{a}_{b}" for a, b in zip(u, u[1:])]
    vocab = {}
    for _, t in docs:
        for w in tok(t):
            vocab.setdefault(w, len(vocab))
    n, v = len(docs), len(vocab)
    tf = np.zeros((n, v))
    for i, (_, t) in enumerate(docs):
        for w in tok(t):
            tf[i, vocab[w]] += 1
        if tf[i].sum():
            tf[i] /= tf[i].sum()
    idf = np.log((n + 1) / ((tf > 0).sum(axis=0) + 1)) + 1
    m = tf * idf
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1
    m /= norms
    q = np.zeros(v)
    for w in tok(query):
        if w in vocab:
            q[vocab[w]] += 1
    q *= idf
    if np.linalg.norm(q):
        q /= np.linalg.norm(q)
    s = m @ q
    return {docs[i][0]: s[i] for i in range(n) if s[i] > 0}


DOCS = [(1, "Profit by region and segment"), (2, ""), (3, "a_b"), (4, "a b a b"),
        (5, "sales sales sales growth"), (6, "profit margin by region"), (7, "region")]


def test_tfidf_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    idx = retrieval.fit_tfidf(docs)
    queries = [(1, "profit by region"), (2, "a b"), (3, "zzz unknown"), (4, "sales")]
    q = spark.createDataFrame(queries, "qid long, text string")
    got = rows(retrieval.score(idx, q))
    for qid, text in queries:
        want = brute_force(DOCS, text)
        have = {r["doc_id"]: r["score"] for r in got if r["qid"] == qid}
        assert set(have) == set(want)
        for d, sc in want.items():
            assert have[d] == pytest.approx(sc, abs=1e-7)  # scores carry 7 decimals
    top = rows(retrieval.retrieve(idx, q, 2))
    assert [r["doc_id"] for r in sorted(top, key=lambda r: (r["qid"], r["rank"])) if r["qid"] == 1] == [1, 6]


def test_tfidf_ties_by_id_and_pins(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z")], "id long, text string")
    idx = retrieval.fit_tfidf(docs)
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    r = rows(retrieval.retrieve(idx, q, 5))
    assert [x["doc_id"] for x in sorted(r, key=lambda x: x["rank"])] == [1, 2]
    p = sorted(rows(retrieval.retrieve_pinned(idx, q, k=1, min_score=0.03, pinned_ids=(3, 2))),
               key=lambda x: x["position"])
    assert [(x["doc_id"], x["pinned"]) for x in p] == [(2, True), (3, True), (1, False)]
    assert p[1]["score"] == 0.0


def test_history_window(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", ("x" * 200) if t == 16 else ("y" * 201) if t == 17 else f"m{t}")
             for t in range(18)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert history.history_window(conv).count() == 16
    s = rows(history.history_summary(conv))[0]
    assert s["kept_messages"] == 16 and s["first_kept_turn"] == 2
    lines = s["summary"].split("\n")
    assert len(lines) == 10 and lines[0] == "User: m8"
    assert lines[-2] == "User: " + "x" * 200 and lines[-1] == "Bot: " + "y" * 200 + "..."
    f = rows(history.followup_query(conv))[0]
    assert f["query"] == "x" * 200 + " " + "y" * 201


def test_saved_index_and_context_block(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    idx = retrieval.fit_tfidf(docs)
    saved = retrieval.save_index(idx, str(tmp_path / "idx"), buckets=4)
    q = spark.createDataFrame([(1, "profit by region")], "qid long, text string")
    a = {(r["doc_id"], r["score"]) for r in retrieval.score(idx, q).collect()}
    b = {(r["doc_id"], r["score"]) for r in retrieval.score(saved, q).collect()}
    assert a == b
    ranked = retrieval.retrieve_pinned(saved, q, k=2, min_score=0.0, pinned_ids=(7,))
    summ = spark.createDataFrame([(1, "User: hi\nBot: hello")], "qid long, summary string")
    ctx = retrieval.context_block(ranked, docs, summaries=summ, max_chunks=2).collect()[0]["context"]
    assert ctx == ("[Recent conversation]\nUser: hi\nBot: hello\n\n[Verified data facts from dashboard]\n"
                   "  - region\n  - Profit by region and segment")


def test_duplicate_ids_and_absent_pins(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "z z"), (2, "x"), (3, "")], "id long, text string")
    once = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "")], "id long, text string")
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    a, b = (sorted(map(tuple, retrieval.retrieve(retrieval.fit_tfidf(d), q, 5).collect())) for d in (docs, once))
    assert a == b
    p = retrieval.retrieve_pinned(retrieval.fit_tfidf(docs), q, k=1, pinned_ids=(77, 3)).collect()
    assert [(r["doc_id"], r["pinned"]) for r in sorted(p, key=lambda r: r["position"])] == [(3, True), (2, False), (1, False)]


def test_missing_value_is_no_trough(spark):
    t = spark.createDataFrame([("2024-01-01", 5.0), ("2024-02-01", None), ("2024-03-01", 3.0)], "period string, sales double")
    r = insights.trend_insights(t.selectExpr("date(period) AS period", "sales"), "sales", "month").collect()[0]
    assert (r["trough_value"], r["peak_value"], r["range"]) == (3.0, 5.0, 2.0)


def test_value_list_with_apostrophe(spark, make_lines):
    from kpiforge.operators import facts
    df = make_lines([line(1, "2024-01-05", region="Children's"), line(2, "2024-01-05", region="Home")])
    text = {r["chunk_id"]: r["text"] for r in facts.build_facts(df).collect()}["dim_region"]
    assert text.startswith("""Dimension 'region' values: ["Children's", 'Home'].""")


def test_text_money_becomes_decimal(spark):
    from kpiforge.sources.order_lines import coerce_order_lines
    df = spark.createDataFrame([("1234,56", "12%", 0.1)], "sales string, discount string, profit double")
    out = coerce_order_lines(df)
    assert dict(out.dtypes) == {"sales": "decimal(12,2)", "discount": "decimal(6,2)", "profit": "decimal(18,4)"}
    assert [str(v) for v in out.collect()[0]] == ["1234.56", "12.00", "0.1000"]
