"""Plan-level KPI queries.

Every function takes the ``order_lines`` DataFrame and returns a DataFrame
with the reference's conventional columns: ``period``, ``breakdown`` and one
column per metric.  Aggregations run as partial (map-side) + final hash
aggregates; exact distinct order counts use Spark's two-level distinct
rewrite, keyed on (group, order_id), so a hot group is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.dates import period_start
from kpiforge.functions.metrics import DIMENSIONS, METRICS, kpi_aggs, metric_cols
from kpiforge.operators.filters import date_window, in_lists


def metric_list(metrics) -> list[str]:
    """One metric name or several, in the order given; any number of them."""
    names = [metrics] if isinstance(metrics, str) else list(metrics or ())
    unknown = [m for m in names if m not in METRICS]
    if unknown or not names:
        raise ValueError(f"expected metrics out of {', '.join(METRICS)}; got {names or 'none'}")
    return names


def dimension(name) -> str | None:
    """A breakdown dimension, or None for none."""
    if name is not None and name not in DIMENSIONS:
        raise ValueError(f"expected a dimension out of {', '.join(DIMENSIONS)}; got {name!r}")
    return name


def row_limit(k) -> int | None:
    """How many rows to return: a positive number, or None for all of them."""
    if k is not None and (isinstance(k, bool) or int(k) != k or k < 1):
        raise ValueError(f"expected a positive number of rows or None; got {k!r}")
    return None if k is None else int(k)


def limited(df: DataFrame, k) -> DataFrame:
    """The first ``k`` rows, or all of them."""
    k = row_limit(k)
    return df if k is None else df.limit(k)


def scoped(df: DataFrame, start=None, end=None, filters=None) -> DataFrame:
    """F1 + F2: the rows a plan looks at."""
    return in_lists(date_window(df, start, end), filters)


def kpi_total(df: DataFrame) -> DataFrame:
    """total_sales, total_profit, total_orders, profit_margin; zeros when empty."""
    return df.agg(*kpi_aggs())


def kpi_value(df: DataFrame, metrics, start=None, end=None, breakdown_by=None,
              filters=None, order_by=None) -> DataFrame:
    """Q1 (one row) or Q2 (one row per dimension value, best first).

    Q1 also returns sales and profit when not asked for, so insights can use
    them (the reference meant to, D1).
    """
    metrics = metric_list(metrics)
    breakdown_by = dimension(breakdown_by)
    rows = scoped(df, start, end, filters)
    if breakdown_by is None:
        support = [m for m in ("sales", "profit") if m not in metrics]
        return rows.agg(*metric_cols(metrics + support))
    order_by = order_by if order_by in metrics else metrics[0]
    return (rows.groupBy(F.col(breakdown_by).alias("breakdown"))
                .agg(*metric_cols(metrics))
                .orderBy(F.col(order_by).desc_nulls_last(), F.col("breakdown").asc_nulls_last()))


def kpi_trend(df: DataFrame, metrics, time_grain: str, start=None, end=None,
              breakdown_by=None, filters=None) -> DataFrame:
    """Q3: one row per period (and dimension value), oldest first."""
    metrics = metric_list(metrics)
    breakdown_by = dimension(breakdown_by)
    if time_grain in (None, "none"):
        raise ValueError("kpi_trend needs a time_grain (D13).")
    rows = scoped(df, start, end, filters)
    keys = [period_start(F.col("order_date"), time_grain).alias("period")]
    order = [F.col("period").asc_nulls_last()]
    if breakdown_by:
        keys.append(F.col(breakdown_by).alias("breakdown"))
        order.append(F.col("breakdown").asc_nulls_last())
    return rows.groupBy(*keys).agg(*metric_cols(metrics)).orderBy(*order)


def kpi_rank(df: DataFrame, metrics, breakdown_by: str, top_k: int | None, start=None, end=None,
             filters=None, order_by=None) -> DataFrame:
    """Q4: top k dimension values by ``order_by`` (all of them for None).

    ``orderBy().limit()`` on the aggregate plans as TakeOrderedAndProject;
    ties at the cut are broken by the dimension value.
    """
    metrics = metric_list(metrics)
    if not breakdown_by:
        raise ValueError("a ranking needs a dimension")
    breakdown_by = dimension(breakdown_by)
    order_by = order_by if order_by in metrics else metrics[0]
    rows = scoped(df, start, end, filters)
    return limited(rows.groupBy(F.col(breakdown_by).alias("breakdown"))
                       .agg(*metric_cols(metrics))
                       .orderBy(F.col(order_by).desc_nulls_last(), F.col("breakdown").asc_nulls_last()), top_k)


def breakdown_all(df: DataFrame, dims=("region", "segment", "category", "sub_category"),
                  metrics=METRICS, approx_orders: bool = False, tasks: int | None = None) -> DataFrame:
    """Every single-dimension breakdown plus the total in ONE scan.

    ``dimension`` names the set (``total`` for the grand total) and ``value``
    holds the group key.  Replaces the dashboard's separate pass per chart.
    For the exact distinct order count lines are dealt by order, once; in its
    task a line becomes one row for each set, lines of an order with the same
    value are summed, and what is left counts as one order there.  No further
    exchange is needed for that: rows that agree in the order lie together.
    The sets are then a plain partial aggregate.  ``tasks``: how many tasks the
    lines are dealt to; lines that lie so already are not moved.
    ``approx_orders=True`` (or no order count) spares that exchange too, at ~1%
    error on ``orders``.
    """
    dims, metrics = list(dims), list(metrics)
    if "orders" in metrics and not approx_orders:
        sets = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims],
                       F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value")))
        rows = df.select("order_id", *dims, "sales", "profit").repartition(*([tasks] if tasks else []), "order_id").select(
            "order_id", "sales", "profit", F.inline(sets))
        once = rows.groupBy("order_id", "dimension", "value").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
        aggs = [F.count("order_id").alias(m) if m == "orders" else a for m, a in zip(metrics, metric_cols(metrics))]
        return once.groupBy("dimension", "value").agg(*aggs).select("dimension", "value", *metrics)
    n = len(dims)
    full = (1 << n) - 1
    sets = [[F.col(d)] for d in dims] + [[]]
    agg = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *metric_cols(metrics, approx_orders=approx_orders), F.grouping_id(*[F.col(d) for d in dims]).alias("_gid"))
    # grouping_id bit i (from the left, most significant first) is 1 when dim i is absent
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        own = F.col("_gid") == (full ^ (1 << (n - 1 - i)))
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(value)
    return agg.select(name.alias("dimension"), value.alias("value"), *metrics)
