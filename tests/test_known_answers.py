"""FIXTURES §2: known answers of the order_lines mapping at sf0.01."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from kpiforge.functions.numeric import discount_bucket
from kpiforge.operators import compare, detail, kpi
from kpiforge.sources.order_lines import order_lines


@pytest.fixture(scope="module")
def ol(spark):
    return order_lines(spark, SF_CHECK).cache()


def test_known_answers(ol):
    t = kpi.kpi_total(ol).collect()[0]
    assert (t["total_sales"], t["total_profit"], t["total_orders"]) == (3183256271.63, 128309451.8907, 14743)
    assert round(t["profit_margin"], 6) == 4.030761
    af = {r["breakdown"]: r for r in kpi.kpi_value(ol, ["profit", "orders"], breakdown_by="region").collect()}
    assert (af["AFRICA"]["profit"], af["AFRICA"]["orders"]) == (27198565.3118, 2830)
    assert kpi.kpi_trend(ol, ["sales"], "week").count() == 345
    assert kpi.kpi_trend(ol, ["sales"], "quarter", breakdown_by="segment").count() == 135
    assert detail.detail_summary(ol, top_k=50).count() == 17
    assert ol.filter(F.col("profit") < 0).count() == 28678
    b = {r[0]: r[1] for r in ol.groupBy(discount_bucket(F.col("discount"))).count().collect()}
    assert (b["0-10%"], b["10-20%"]) == (14973, 12122)
    c = {r["breakdown"]: r for r in compare.kpi_compare(ol, "profit", date(2000, 1, 1), date(2000, 12, 31), "yoy",
                                                          breakdown_by="region").collect()}
    assert (c["ASIA"]["current"], c["ASIA"]["previous"]) == (5717204.8749, 2463357.545)
    assert kpi.breakdown_all(ol).count() == 42
