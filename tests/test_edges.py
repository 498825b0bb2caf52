"""Empty input (every operator returns its schema), NULL keys, type coercion on load."""

from datetime import date

import pytest

from conftest import OL_SCHEMA, line
from kpiforge.operators import compare, dashboard, detail, facts, history, insights, kpi, retrieval
from kpiforge.sources.order_lines import coerce_order_lines, filter_options, preview


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], OL_SCHEMA)


def test_empty_inputs(spark, empty):
    frames = {
        "value": kpi.kpi_value(empty, ["sales"], breakdown_by="region"),
        "trend": kpi.kpi_trend(empty, ["sales"], "month"),
        "rank": kpi.kpi_rank(empty, ["profit"], "state", 3),
        "all": kpi.breakdown_all(empty),
        "cmp_by": compare.kpi_compare(empty, "sales", "2024-01-01", "2024-01-31", "mom", "region"),
        "detail": detail.detail_summary(empty),
        "rows": detail.detail_rows(empty),
        "b1": dashboard.sales_profit_by_month(empty),
        "b5": dashboard.profit_heatmap(empty, regions=["A", "B"]),
        "b6": dashboard.discount_impact(empty),
        "b8": dashboard.category_share(empty),
        "preview": preview(empty),
    }
    for name, df in frames.items():
        assert df.count() == 0, name
        assert len(df.columns) > 0, name
    one = kpi.kpi_value(empty, ["sales", "orders"]).collect()
    assert len(one) == 1 and one[0]["sales"] is None and one[0]["orders"] == 0
    c = compare.kpi_compare(empty, "sales", "2024-01-01", "2024-01-31", "yoy").collect()[0]
    assert (c["current"], c["previous"], c["change_pct"]) == (0.0, 0.0, None)
    f = {r["chunk_id"]: r["text"] for r in facts.build_facts(empty).collect()}
    assert set(f) == {"schema_metrics", "schema_dimensions", "schema_compare", "schema_intents",
                      "filter_context", "kpi_summary", "kpi_profitability"}
    assert "Total Sales=$0, Total Profit=$0, Total Orders=0, Profit Margin=0.00%" in f["kpi_summary"]
    o = filter_options(empty).collect()[0]
    assert o["regions"] == [] and o["min_date"] is None


def test_empty_text_inputs(spark):
    docs = spark.createDataFrame([], "id long, text string")
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    assert retrieval.retrieve(retrieval.fit_tfidf(docs), q, 3).count() == 0
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert history.history_summary(conv).count() == 0 and history.followup_query(conv).count() == 0
    t = spark.createDataFrame([], "period date, v double")
    assert insights.trend_insights(t, "v", "year").count() == 0


def test_null_region_kept_by_kpi_dropped_by_charts(make_lines):
    df = make_lines([line(1, "2024-01-01", region=None), line(2, "2024-01-01", region="A")])
    assert {r["breakdown"] for r in kpi.kpi_value(df, ["sales"], breakdown_by="region").collect()} == {None, "A"}
    assert [r["region"] for r in dashboard.profit_by(df, "region").collect()] == ["A"]
    assert filter_options(df).collect()[0]["regions"] == ["A"]


def test_coerce_text_columns(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-05", "2024-01-07", "A", "12,5", "10%", " 3 "), ("2", "not a date", None, "B", "x", "5", "1.0d")],
        "order_id string, order_date string, ship_date string, region string, sales string, discount string, "
        "profit string")
    out = coerce_order_lines(raw).orderBy("order_id").collect()
    assert out[0]["order_date"] == date(2024, 1, 5) and out[0]["ship_date"] == date(2024, 1, 7)
    assert (out[0]["sales"], out[0]["discount"], out[0]["profit"]) == (12.5, 10.0, 3.0)
    assert out[1]["order_date"] is None and out[1]["sales"] is None and out[1]["profit"] is None
    assert dict(coerce_order_lines(raw).dtypes)["order_date"] == "date"


def test_load_orders_with_filters(spark, tmp_path):
    from conftest import SF_SMALL
    from kpiforge.sources.order_lines import load_orders, order_lines, year_predicates
    path = str(tmp_path / "wide")
    order_lines(spark, SF_SMALL).write.parquet(path)
    f = {"date_range": ("1997-01-01", "1997-12-31"), "region": ["ASIA"], "segment": []}
    got = load_orders(spark, path, f)
    want = kpi.kpi_value(order_lines(spark, SF_SMALL), ["sales", "orders"], "1997-01-01", "1997-12-31",
                         filters={"region": ["ASIA"]}).collect()[0]
    assert kpi.kpi_value(got, ["sales", "orders"]).collect()[0] == want
    assert year_predicates(1997, 1998)[1] == "order_date >= DATE '1998-01-01' AND order_date < DATE '1999-01-01'"


def test_explicit_partitions_deal_rows_round_robin(spark, tmp_path):
    from kpiforge.sources.tables import read_table

    spark.range(100).write.parquet(str(tmp_path / "region.parquet"))
    df = read_table(spark, str(tmp_path), "region", partitions=7)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 100
    assert "RoundRobinPartitioning" in df._jdf.queryExecution().toString()
