"""Question tagging (G1-G10) on the FIXTURES question list."""

import os
import sys
from datetime import date

from pyspark.sql import functions as F

from conftest import line

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from kpiforge.operators.questions import tag_questions

QUESTIONS = ["total sales", "profit by region", "top 3 sub-categories by profit", "sales in Q1 2017",
             "sales 13/02/2016 to 01/02/2016", "which products are losing money", "sales past 30 days",
             "sales this quarter", "profit vs last year", "highest and lowest state by sales", "", None,
             "sales in EAST for 2017", "monthly profit for phones"]


def test_tags(spark, make_lines):
    ol = make_lines([line(1, "2016-01-01", region="EAST", sub_category="Phones"),
                     line(2, "2017-12-31", region="WEST", sub_category="Chairs")])
    qs = spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, text string")
    out = {r["id"]: r.asDict() for r in tag_questions(qs, ol).collect()}
    lo, hi = date(2016, 1, 1), date(2017, 12, 31)

    r = out[0]
    assert (r["intent"], r["fast_kpi"], r["start_date"], r["end_date"]) == (None, "total_sales", lo, hi)
    r = out[1]
    assert (r["intent"], r["metrics"], r["breakdown"], r["fast_kpi"]) == ("kpi_value", ["profit"], "region", None)
    r = out[2]
    assert (r["intent"], r["breakdown"], r["top_k"]) == ("kpi_rank", "sub_category", 3)
    r = out[3]
    assert (r["intent"], r["start_date"], r["end_date"], r["time_grain"]) == \
        ("kpi_value", date(2017, 1, 1), date(2017, 3, 31), None)
    r = out[4]
    assert (r["intent"], r["start_date"], r["end_date"]) == ("kpi_value", date(2016, 2, 1), date(2016, 2, 13))
    r = out[5]
    assert (r["intent"], r["breakdown"], r["top_k"], r["metrics"], r["is_loss"]) == \
        ("kpi_detail", "sub_category", 15, ["sales", "profit"], True)
    r = out[6]
    assert (r["intent"], r["start_date"], r["end_date"]) == ("kpi_value", date(2017, 12, 1), hi)
    r = out[7]
    assert (r["intent"], r["start_date"], r["end_date"], r["time_grain"]) == \
        ("kpi_value", date(2017, 10, 1), hi, None)
    r = out[8]
    assert (r["intent"], r["time_grain"], r["metrics"], r["compare_period"]) == \
        ("kpi_trend", "year", ["profit"], None)
    r = out[9]
    assert (r["intent"], r["breakdown"], r["top_k"], r["is_extremes"]) == ("kpi_rank", "state", 1, True)
    assert out[10]["intent"] is None and out[10]["fast_kpi"] is None
    assert out[11]["intent"] is None
    r = out[12]
    assert (r["intent"], r["breakdown"], r["mentioned_region"], r["start_date"]) == \
        ("kpi_value", "region", ["EAST"], date(2017, 1, 1))
    r = out[13]
    assert (r["intent"], r["time_grain"], r["breakdown"], r["mentioned_sub_category"]) == \
        ("kpi_trend", "month", "sub_category", ["Phones"])


MORE = QUESTIONS[:10] + [
    "profit in asia vs europe", "monthly sales for AUTOMOBILE", "which region had the strongest growth",
    "show year-over-year sales trend", "sales month over month", "compare profit by segment",
    "top 5 states by orders in 2016", "orders from 2016-01-01 to 2016-03-31", "revenue in march 2016",
    "profit margin", "kpi overview", "number of orders", "sales past 2 weeks by region",
    "best and worst category by profit", "profit 1/2/2016 and 3/4/2016", "sales for brand#1 this year",
    "total profit", "loss-making products in africa", "sales per sub-category", "income by province"]


def test_tags_match_sql(spark):
    """The Spark job and the registered DuckDB SQL agree on meaningful questions."""
    import duckdb
    import pandas as pd

    from check_oracle import rows_of
    from conftest import SF_SMALL
    from kpiforge import catalog
    from kpiforge.sources.order_lines import order_lines
    from kpiforge.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        if t != "conversations":
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    conv = pd.DataFrame({"conv_id": list(range(len(MORE))), "turn": [0] * len(MORE),
                         "role": ["user"] * len(MORE), "text": MORE})
    con.register("conversations", conv)
    want = con.sql(catalog.ORACLE_SQL["question_tags"]).arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    qs = spark.createDataFrame(conv).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    t = tag_questions(qs, order_lines(spark, SF_SMALL))
    from kpiforge.operators.questions import VALUE_DIMS
    got = t.select("id", "text", "intent", F.array_join("metrics", ",").alias("metrics"),
                   *[c for c in t.columns if c not in ("id", "text", "intent", "metrics")
                     and not c.startswith("mentioned_")],
                   *[F.array_join(f"mentioned_{d}", "|").alias(f"mentioned_{d}") for d in VALUE_DIMS]).toArrow()
    a, b = rows_of(got, False), rows_of(want, False)
    assert [r for r in a if r not in b] == [] and len(a) == len(b)
    assert sorted(got.column_names) == sorted(want.column_names)


# answers derived by hand: a superlative asks for the first one only of a dimension the question names, not of a value's
SUPERLATIVES = [("best sales in EAST", "kpi_value", "region", None), ("highest profit for Consumer", "kpi_value", "segment", None),
                ("best region by profit", "kpi_rank", "region", 1), ("most profit in EAST by category", "kpi_rank", "category", 1),
                ("at least sales", "kpi_value", "region", None)]


def test_superlatives(spark, make_lines):
    ol = make_lines([line(1, "2016-01-01", region="EAST", segment="Consumer"), line(2, "2017-12-31", region="WEST", segment="Corporate")])
    qs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(SUPERLATIVES)], "id long, text string")
    out = {r["id"]: r for r in tag_questions(qs, ol).collect()}
    for i, (text, intent, dim, k) in enumerate(SUPERLATIVES):
        assert (out[i]["intent"], out[i]["breakdown"], out[i]["top_k"]) == (intent, dim, k), text
    # EAST occurs inside "least": it sets the breakdown, but is no value named as a word
    assert out[4]["mentioned_region"] == [] and out[0]["mentioned_region"] == ["EAST"]


def test_mentions_in_repeated_and_odd_questions(spark, make_lines):
    ol = make_lines([line(1, "2016-01-01", region="A+B", sub_category="X"), line(2, "2016-01-02", region="WEST", sub_category="Y Z"),
                     line(3, "2016-01-03", region=None, sub_category=None)])
    qs = spark.createDataFrame([(1, "sales of x in west"), (2, "sales of x in west"), (3, None), (4, "y z, a+b and west"), (None, "X")],
                               "id long, text string")
    out = sorted(tag_questions(qs, ol).collect(), key=lambda r: (r["id"] is None, r["id"]))
    assert [r["mentioned_region"] for r in out] == [["WEST"], ["WEST"], [], [], []]  # both regions named: no filter
    assert [r["mentioned_sub_category"] for r in out] == [["X"], ["X"], [], ["Y Z"], ["X"]]


def test_composed_questions_reach_every_rule(spark):
    from kpiforge import catalog
    from conftest import SF_CHECK
    rows = catalog.QUERIES["question_forms"](spark, SF_CHECK).collect()
    seen = {c: {r[c] for r in rows} for c in rows[0].asDict()}
    assert {"kpi_value", "kpi_trend", "kpi_rank", "kpi_compare", "kpi_detail", None} <= seen["intent"]
    assert {"summary", "total_sales", "total_profit", "total_orders", "margin"} <= seen["fast_kpi"]
    assert {"region", "segment", "category", "sub_category", "state"} <= seen["breakdown"]
    assert {"week", "month", "quarter", "year"} <= seen["time_grain"] and {"yoy", "prev_period"} <= seen["compare_period"]
    assert {1, 3, 10, 15} <= seen["top_k"]
    for flag in ("is_loss", "is_extremes", "is_growth_rank"):
        assert seen[flag] == {True, False}
    for d in ("region", "segment", "category", "sub_category"):
        assert len(seen[f"mentioned_{d}"]) > 2
