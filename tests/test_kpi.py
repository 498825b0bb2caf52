"""KPI queries, comparisons, drill-down, dashboard frames on micro fixtures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import line
from kpiforge.functions.dates import previous_window, shift_months
from kpiforge.operators import compare, dashboard, detail, kpi


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_kpi_total_and_empty(make_lines):
    df = make_lines([line(1, "2024-01-01", sales="100.00", profit="5.0000"),
                     line(1, "2024-01-02", sales="50.00", profit="-2.0000"),
                     line(2, "2024-01-03", sales="50.00", profit="1.0000")])
    r = rows(kpi.kpi_total(df))[0]
    assert r == {"total_sales": 200.0, "total_profit": 4.0, "total_orders": 2, "profit_margin": 2.0}
    empty = rows(kpi.kpi_total(df.limit(0)))[0]
    assert empty == {"total_sales": 0.0, "total_profit": 0.0, "total_orders": 0, "profit_margin": 0.0}


def test_zero_sales_margin_is_zero(make_lines):
    df = make_lines([line(1, "2024-01-01", region="A", sales="0.00", profit="-3.0000"),
                     line(2, "2024-01-01", region="B", sales="10.00", profit="1.0000")])
    out = {r["breakdown"]: r for r in rows(kpi.kpi_value(df, ["profit_margin"], breakdown_by="region"))}
    assert out["A"]["profit_margin"] == 0.0
    assert out["B"]["profit_margin"] == pytest.approx(10.0)


def test_value_keeps_null_group_and_orders_desc(make_lines):
    df = make_lines([line(1, "2024-01-01", region=None, sales="5.00"),
                     line(2, "2024-01-01", region="A", sales="7.00"),
                     line(3, "2024-01-01", region="B", sales="9.00")])
    out = rows(kpi.kpi_value(df, ["sales"], breakdown_by="region"))
    assert [r["breakdown"] for r in out] == ["B", "A", None]
    one = rows(kpi.kpi_value(df, ["orders"]))[0]
    assert one == {"orders": 3, "sales": 21.0, "profit": 3.0}  # support metrics fetched (D1)


def test_dates_inclusive_and_in_lists(make_lines):
    df = make_lines([line(1, "2024-01-01", region="A"), line(2, "2024-01-31", region="A"),
                     line(3, "2024-02-01", region="A"), line(4, "2024-01-15", region="B")])
    r = rows(kpi.kpi_value(df, ["orders"], "2024-01-01", "2024-01-31", filters={"region": ["A"]}))[0]
    assert r["orders"] == 2
    r = rows(kpi.kpi_value(df, ["orders"], "2024-01-01", "2024-01-31", filters={"region": []}))[0]
    assert r["orders"] == 3


def test_trend_week_starts_monday(make_lines):
    df = make_lines([line(1, "1995-01-01"), line(2, "1995-01-02")])  # Sunday, Monday
    out = rows(kpi.kpi_trend(df, ["orders"], "week"))
    assert [(r["period"], r["orders"]) for r in out] == [(date(1994, 12, 26), 1), (date(1995, 1, 2), 1)]


def test_rank_ties_and_limits(make_lines):
    df = make_lines([line(i, "2024-01-01", sub_category=s, profit=p)
                     for i, (s, p) in enumerate([("a", "5"), ("b", "5"), ("c", "7"), ("d", "1")])])
    out = rows(kpi.kpi_rank(df, ["profit"], "sub_category", 2))
    assert [r["breakdown"] for r in out] == ["c", "a"]
    assert kpi.kpi_rank(df, ["profit"], "sub_category", 51).count() == 4  # plans, not operators, limit the number of rows
    with pytest.raises(ValueError):
        kpi.kpi_rank(df, ["profit"], None, 5)


def test_validation_errors(make_lines):
    df = make_lines([line(1, "2024-01-01")])
    assert kpi.kpi_value(df, ["sales", "profit", "orders"]).count() == 1  # plans, not operators, limit the number of metrics
    with pytest.raises(ValueError):
        kpi.kpi_value(df, ["revenue"])
    with pytest.raises(ValueError):
        kpi.kpi_value(df, ["sales"], breakdown_by="city")
    with pytest.raises(ValueError):
        kpi.kpi_trend(df, ["sales"], "none")
    with pytest.raises(ValueError):
        compare.kpi_compare(df, ["sales", "profit"], "2024-01-01", "2024-01-31", "yoy")
    with pytest.raises(ValueError):
        compare.kpi_compare(df, "sales", "2024-01-01", "2024-01-31", "qoq")


def test_month_end_windows():
    assert shift_months(date(2024, 3, 31), -1) == date(2024, 2, 29)
    assert shift_months(date(2024, 2, 29), -12) == date(2023, 2, 28)
    assert previous_window("2024-01-01", "2024-01-31", "prev_period") == (date(2023, 12, 1), date(2023, 12, 31))
    assert previous_window("2024-03-01", "2024-03-31", "mom") == (date(2024, 2, 1), date(2024, 2, 29))


def test_compare_scalar_and_by_dimension(make_lines):
    df = make_lines([
        line(1, "2024-02-10", region="A", sales="30.00"),  # current
        line(2, "2023-02-10", region="A", sales="20.00"),  # previous
        line(3, "2024-02-11", region="NEW", sales="5.00"),  # only current
        line(4, "2023-02-11", region="GONE", sales="8.00"),  # only previous
        line(5, "2024-02-12", region="Z", sales="0.00"),
        line(6, "2023-02-12", region="Z", sales="0.00"),
    ])
    one = rows(compare.kpi_compare(df, "sales", "2024-02-01", "2024-02-29", "yoy"))[0]
    assert (one["current"], one["previous"]) == (35.0, 28.0)
    assert one["prev_start"] == date(2023, 2, 1) and one["prev_end"] == date(2023, 2, 28)
    assert one["change_pct"] == pytest.approx(25.0)
    by = rows(compare.kpi_compare(df, "sales", "2024-02-01", "2024-02-29", "yoy", breakdown_by="region"))
    got = {r["breakdown"]: (r["current"], r["previous"], r["change_pct"]) for r in by}
    assert got == {"A": (30.0, 20.0, pytest.approx(50.0)), "NEW": (5.0, 0.0, None), "Z": (0.0, 0.0, None)}
    assert [r["breakdown"] for r in by][-1] in ("NEW", "Z")  # NULL change last


def test_compare_equals_value(make_lines):
    df = make_lines([line(i, f"2024-01-{i:02d}", sales=f"{i}.00") for i in range(1, 20)])
    v = rows(kpi.kpi_value(df, ["sales"], "2024-01-05", "2024-01-10"))[0]["sales"]
    c = rows(compare.kpi_compare(df, "sales", "2024-01-05", "2024-01-10", "prev_period"))[0]
    assert c["current"] == v
    assert c["previous"] == sum(range(1, 5)) * 1.0  # 2023-12-30 .. 2024-01-04


def test_detail_summary_and_rows(make_lines):
    df = make_lines([
        line(1, "2024-01-01", sub_category="s1", category="c", sales="10.00", profit="-4.0000", discount="0.40"),
        line(2, "2024-01-01", sub_category="s1", category="c", sales="10.00", profit="-1.0000", discount="0.20"),
        line(3, "2024-01-01", sub_category="s2", category="c", sales="10.00", profit="3.0000", discount="0.00"),
    ])
    s = rows(detail.loss_reason(detail.detail_summary(df)))
    assert len(s) == 1
    assert s[0]["breakdown"] == "s1" and s[0]["avg_discount_pct"] == 30.0
    assert s[0]["profit_margin"] == -25.0 and s[0]["loss_reason"] == "heavy_discount"
    r = rows(detail.detail_rows(df))
    assert [x["order_id"] for x in r] == [1, 2]
    r2 = rows(detail.detail_rows(df.drop("product_name")))
    assert "product_name" not in r2[0]


@pytest.mark.parametrize("n_rows,n", [(1, 0), (2, 1), (3, 1), (9, 3), (12, 3)])
def test_extremes_sizes(spark, n_rows, n):
    res = spark.createDataFrame([(f"b{i:02d}", float(i)) for i in range(n_rows)], "breakdown string, v double")
    out = rows(detail.extremes(res, "v"))
    assert len([r for r in out if r["side"] == "top"]) == n
    bottom = sorted([r for r in out if r["side"] == "bottom"], key=lambda r: r["rank"])
    if n:
        assert bottom[0]["value"] == 0.0  # worst first


def test_discount_buckets_edges(spark):
    vals = ["0", "0.1", "0.1001", "0.2", "0.3", "0.3001", "1.0", "1.01", "-0.01", None]
    df = spark.createDataFrame([(v,) for v in vals], "d string").select(
        F.col("d").cast("decimal(6,4)").alias("d"))
    from kpiforge.functions.numeric import discount_bucket
    got = [r[0] for r in df.select(discount_bucket(F.col("d"))).collect()]
    assert got == ["0-10%", "0-10%", "10-20%", "10-20%", "20-30%", ">30%", ">30%", None, None, None]


def test_percent_discount_rescaled(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (10.0, 2.0, 2.0), (20.0, 3.0, 3.0), (35.0, 4.0, 4.0)],
                               "discount double, sales double, profit double")
    out = {r["discount_bucket"]: r["avg_sales"] for r in dashboard.discount_impact(df).collect()}
    assert out == {"0-10%": 1.5, "10-20%": 3.0, ">30%": 4.0}


def test_text_numbers(spark):
    from kpiforge.functions.numeric import clean_numeric
    df = spark.createDataFrame([("12,5%",), (" 7 ",), ("1.234,5",), ("abc",), ("1.0d",), (None,)], "v string")
    got = [r[0] for r in df.select(clean_numeric(F.col("v"))).collect()]
    assert got == [12.5, 7.0, None, None, None, None]


def test_dashboard_drops_null_keys(make_lines):
    df = make_lines([line(1, "2024-01-01", region=None, profit="2.0000"),
                     line(2, "2024-01-01", region="A", profit="3.0000"),
                     line(3, None, region="A", profit="4.0000")])
    assert rows(dashboard.profit_by(df, "region")) == [{"region": "A", "profit": 7.0}]
    assert [r["order_date"] for r in rows(dashboard.sales_profit_by_month(df))] == [date(2024, 1, 1)]
    share = rows(dashboard.category_share(df))
    assert share[0]["share_pct"] == pytest.approx(100.0)


def test_breakdown_all_matches_group_bys(make_lines):
    df = make_lines([line(i, "2024-01-01", region=r, segment=s, sales=f"{i}.00")
                     for i, (r, s) in enumerate([("A", "x"), ("A", "y"), ("B", "y"), ("B", "x")], 1)])
    out = rows(kpi.breakdown_all(df, dims=("region", "segment")))
    got = {(r["dimension"], r["value"]): r["sales"] for r in out}
    assert got == {("region", "A"): 3.0, ("region", "B"): 7.0, ("segment", "x"): 5.0,
                   ("segment", "y"): 5.0, ("total", None): 10.0}


def test_labels_and_approx(spark, make_lines):
    from kpiforge.functions.dates import context_label, period_label
    d = spark.createDataFrame([(date(2014, 1, 6),), (date(2014, 4, 1),)], "d date")
    got = d.select(*[period_label(F.col("d"), g).alias(g) for g in ("year", "quarter", "month", "week")],
                   context_label(F.col("d")).alias("ctx")).collect()
    assert tuple(got[0]) == ("2014", "2014 Q1", "2014-01", "2014-01-06", "Jan 2014")
    assert got[1]["quarter"] == "2014 Q2"
    df = make_lines([line(i % 7, "2024-01-01", region="AB"[i % 2]) for i in range(40)])
    exact = {r["value"]: r["orders"] for r in kpi.breakdown_all(df, ("region",)).collect()}
    approx = {r["value"]: r["orders"] for r in kpi.breakdown_all(df, ("region",), approx_orders=True).collect()}
    assert exact == approx == {"A": 7, "B": 7, None: 7}


def test_dashboard_frames_equal_single_charts(spark):
    from conftest import SF_SMALL
    from kpiforge.sources.order_lines import order_lines
    df = order_lines(spark, SF_SMALL)
    frames = dashboard.dashboard_frames(df)
    single = {
        "sales_profit_by_month": dashboard.sales_profit_by_month(df),
        "orders_by_month": dashboard.orders_by_month(df),
        "profit_by_region": dashboard.profit_by(df, "region"),
        "profit_by_segment": dashboard.profit_by(df, "segment"),
        "profit_heatmap": dashboard.profit_heatmap(df),
        "discount_impact": dashboard.discount_impact(df),
        "top_sub_categories": dashboard.top_sub_categories(df),
        "category_share": dashboard.category_share(df),
    }
    for name, want in single.items():
        assert frames[name].columns == want.columns, name
        assert frames[name].collect() == want.collect(), name
