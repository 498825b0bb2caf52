"""Plan validation (one test per rule of the reference's validator) and dispatch."""

from datetime import date

import pytest

from conftest import line
from kpiforge.plans import run_plan, validate_plan

DR = (date(2024, 1, 1), date(2024, 12, 31))


@pytest.mark.parametrize("raw", [
    "not a dict",
    {"intent": "forecast"},
    {"intent": "clarify"},
    {"intent": "kpi_value", "metrics": []},
    {"intent": "kpi_value", "metrics": ["sales", "profit", "orders"]},
    {"intent": "kpi_value", "metrics": ["units"]},
    {"intent": "kpi_value", "metrics": ["sales"], "time_grain": "day"},
    {"intent": "kpi_value", "metrics": ["sales"], "breakdown_by": "city"},
    {"intent": "kpi_value", "metrics": ["sales"], "top_k": 0},
    {"intent": "kpi_value", "metrics": ["sales"], "top_k": "many"},
    {"intent": "kpi_value", "metrics": ["sales"], "start_date": "2024-13-01"},
    {"intent": "kpi_value", "metrics": ["sales"], "start_date": "2024-05-01", "end_date": "2024-04-01"},
    {"intent": "kpi_value", "metrics": ["sales"], "filters": {"region": "EAST"}},
    {"intent": "kpi_rank", "metrics": ["sales"], "top_k": 3},
    {"intent": "kpi_rank", "metrics": ["sales"], "breakdown_by": "region"},
    {"intent": "kpi_rank", "metrics": ["sales"], "breakdown_by": "region", "top_k": 3, "time_grain": "month"},
    {"intent": "kpi_compare", "metrics": ["sales"]},
    {"intent": "kpi_compare", "metrics": ["sales", "profit"], "compare_period": "yoy"},
    {"intent": "kpi_compare", "metrics": ["sales"], "compare_period": "qoq"},
    {"intent": "kpi_compare", "metrics": ["sales"], "compare_period": "yoy", "breakdown_by": "region",
     "time_grain": "month"},
])
def test_invalid_plans(raw):
    with pytest.raises(ValueError):
        validate_plan(raw, DR)


def test_normalisation():
    p = validate_plan({"intent": "kpi_value", "metrics": "profit", "time_grain": "month", "order_by": "x"}, DR)
    assert (p.intent, p.metrics, p.order_by, p.start_date) == ("kpi_trend", ("profit",), "profit", DR[0])
    d = validate_plan({"intent": "kpi_detail", "condition": "weird"}, DR)
    assert (d.condition, d.breakdown_by, d.top_k) == ("profit_negative", "sub_category", 15)


def test_run_plan(make_lines):
    df = make_lines([line(1, "2024-01-05", region="A", profit="-2.0000"),
                     line(2, "2023-01-05", region="A", profit="4.0000")])
    v = run_plan(df, validate_plan({"intent": "kpi_value", "metrics": ["profit"], "breakdown_by": "region"}, DR))
    assert v.collect()[0]["profit"] == -2.0
    c = run_plan(df, validate_plan({"intent": "kpi_compare", "metrics": ["profit"], "compare_period": "yoy"}, DR))
    r = c.collect()[0]
    assert (r["current"], r["previous"], r["change_pct"]) == (-2.0, 4.0, -150.0)
    s, rows = run_plan(df, validate_plan({"intent": "kpi_detail"}, DR))
    assert s.count() == 1 and rows.count() == 1


def test_run_plan_extremes(make_lines):
    df = make_lines([line(i, "2024-01-05", region=r, sales=f"{i}.00") for i, r in enumerate("ABCDEF", 1)])
    res, ext = run_plan(df, validate_plan({"intent": "kpi_value", "metrics": ["sales"], "breakdown_by": "region",
                                           "show_extremes": True}, DR))
    assert res.count() == 6
    got = {(r["side"], r["rank"]): r["breakdown"] for r in ext.collect()}
    assert got == {("top", 1): "F", ("top", 2): "E", ("bottom", 1): "A", ("bottom", 2): "B"}


def test_api_wrappers(make_lines):
    from kpiforge.operators import detail, insights, kpi
    df = make_lines([line(i, "2024-01-05", region=r, profit=p) for i, (r, p) in enumerate(
        [("A", "-3"), ("B", "5"), ("C", "1")], 1)])
    s, rows = detail.kpi_detail(df, breakdown_by="region")
    assert [r["breakdown"] for r in s.collect()] == ["A"] and rows.count() == 1
    table, summary = insights.rank_insights(kpi.kpi_value(df, ["profit"], breakdown_by="region"), "profit")
    assert [r["breakdown"] for r in table.orderBy("rank").collect()] == ["B", "C", "A"]
    assert summary.collect()[0]["leader"] == "B"


def test_limits_belong_to_plans_not_operators(make_lines):
    from kpiforge.operators import kpi
    df = make_lines([line(i, "2024-01-05", sub_category=f"s{i}") for i in range(60)])
    assert kpi.kpi_rank(df, ["sales", "profit", "orders"], "sub_category", 55).count() == 55
    assert kpi.kpi_rank(df, "sales", "sub_category", None).count() == 60
    for k in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            kpi.kpi_rank(df, "sales", "sub_category", k)
    with pytest.raises(ValueError) as e:
        validate_plan({"intent": "kpi_rank", "metrics": ["sales"], "breakdown_by": "region", "top_k": 51}, DR)
    assert e.value.part == "top_k"
