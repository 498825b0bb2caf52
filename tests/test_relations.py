"""SURVEY §5.4 relations on random order-line frames (hypothesis)."""

from datetime import date, timedelta
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import OL_SCHEMA
from kpiforge.operators import compare, kpi

ROW = st.tuples(
    st.integers(1, 40),                                   # order_id
    st.integers(0, 900),                                  # day offset
    st.sampled_from(["A", "B", "C", None]),               # region
    st.sampled_from(["x", "y"]),                          # segment
    st.integers(-5000, 50000),                            # sales in cents
    st.integers(-900000, 900000),                         # profit in 1/10000
)


def frame(spark, rows):
    base = date(2020, 1, 1)
    data = [(o, base + timedelta(days=d), None, r, "s", seg, "c", "sc", "p",
             Decimal(s) / 100, Decimal("0.10"), Decimal(p) / 10000) for o, d, r, seg, s, p in rows]
    return spark.createDataFrame(data, OL_SCHEMA)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(ROW, min_size=1, max_size=30))
def test_relations(spark, rows):
    df = frame(spark, rows).cache()
    total = kpi.kpi_total(df).collect()[0]
    exact_sales = sum(Decimal(r[4]) / 100 for r in rows)
    exact_profit = sum(Decimal(r[5]) / 10000 for r in rows)
    assert total["total_sales"] == float(exact_sales) and total["total_profit"] == float(exact_profit)
    assert total["total_orders"] == len({r[0] for r in rows})

    by_region = kpi.kpi_value(df, ["sales", "profit"], breakdown_by="region").collect()
    assert sum(Decimal(str(r["sales"])) for r in by_region) == exact_sales
    trend = kpi.kpi_trend(df, ["profit"], "month").collect()
    assert sum(Decimal(str(r["profit"])) for r in trend) == exact_profit

    sets = {(r["dimension"], r["value"]): r for r in kpi.breakdown_all(df, ("region", "segment")).collect()}
    for r in by_region:
        assert sets[("region", r["breakdown"])]["sales"] == r["sales"]
    seg = {r["breakdown"]: r["orders"] for r in kpi.kpi_value(df, ["orders"], breakdown_by="segment").collect()}
    for k, v in seg.items():
        assert sets[("segment", k)]["orders"] == v
    assert sets[("total", None)]["orders"] == total["total_orders"]

    start, end = "2020-06-01", "2021-05-31"
    v = kpi.kpi_value(df, ["sales"], start, end).collect()[0]["sales"] or 0.0
    c = compare.kpi_compare(df, "sales", start, end, "yoy").collect()[0]
    p = kpi.kpi_value(df, ["sales"], c["prev_start"], c["prev_end"]).collect()[0]["sales"] or 0.0
    assert (c["current"], c["previous"]) == (v, p)
    df.unpersist()
