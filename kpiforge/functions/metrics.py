"""Metric registry (A1-A6): name -> aggregate Column.

Sums run over DECIMAL columns (exact, order independent) and are cast to
DOUBLE only at the end, so every engine produces the same bits for them.
Ratios are computed from those doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("sales", "profit", "orders", "profit_margin")
DIMENSIONS = ("region", "segment", "category", "sub_category", "state")


def ratio_pct(num: Column, den: Column) -> Column:
    """``num / den * 100`` with the reference's guard: 0 when den is 0.

    NULL stays NULL (SQL semantics of ``CASE WHEN SUM(x)=0 ... END``).
    """
    num_d, den_d = num.cast("double"), den.cast("double")
    return F.when(den_d == 0, F.lit(0.0)).otherwise(F.try_divide(num_d, den_d) * 100)


def change_pct(cur: Column, prev: Column) -> Column:
    """``(cur - prev) / abs(prev) * 100``; NULL when prev is 0 or NULL."""
    cur_d, prev_d = cur.cast("double"), prev.cast("double")
    return F.when(prev_d != 0, (cur_d - prev_d) / F.abs(prev_d) * 100)


def metric_agg(name: str, cond: Column | None = None, approx_orders: bool = False) -> Column:
    """Aggregate for one metric, optionally only over rows where ``cond`` holds.

    ``approx_orders`` counts orders with HyperLogLog (``approx_count_distinct``,
    a plain partial aggregate) instead of the exact distinct count, which
    Spark evaluates by grouping on (key, order_id)."""
    if name not in METRICS:
        raise ValueError(f"Invalid metric: {name!r}")

    def only(c: str) -> Column:
        return F.col(c) if cond is None else F.when(cond, F.col(c))

    if name == "sales":
        return F.sum(only("sales")).cast("double")
    if name == "profit":
        return F.sum(only("profit")).cast("double")
    if name == "orders":
        return F.approx_count_distinct(only("order_id")) if approx_orders else F.count_distinct(only("order_id"))
    return ratio_pct(F.sum(only("profit")), F.sum(only("sales")))


def metric_cols(metrics, cond: Column | None = None, approx_orders: bool = False) -> list[Column]:
    return [metric_agg(m, cond, approx_orders).alias(m) for m in metrics]


def kpi_aggs() -> list[Column]:
    """The four headline KPIs (A7), zero instead of NULL on empty input."""
    s, p = F.sum("sales"), F.sum("profit")
    return [
        F.coalesce(s.cast("double"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(p.cast("double"), F.lit(0.0)).alias("total_profit"),
        F.count_distinct("order_id").alias("total_orders"),
        F.coalesce(ratio_pct(p, s), F.lit(0.0)).alias("profit_margin"),
    ]
