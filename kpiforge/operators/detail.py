"""Loss drill-down and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.operators.filters import condition
from kpiforge.operators.kpi import dimension, limited, scoped

ROW_SAMPLE = 10
DETAIL_COLUMNS = ("order_id", "order_date", "breakdown", "category", "product_name",
                  "sales", "profit", "discount")


def detail_summary(df: DataFrame, breakdown_by: str = "sub_category", start=None, end=None,
                   filters=None, top_k: int | None = 15) -> DataFrame:
    """(breakdown, category) groups whose summed profit is negative, worst first.

    orders, sales (2 dp), profit (2 dp), avg_discount_pct (1 dp), profit_margin
    (2 dp, 0 when sales is 0); HAVING sum(profit) < 0; at most ``top_k`` (None: every group).
    Rounding is done on the exact DECIMAL sums.
    """
    breakdown_by = dimension(breakdown_by or "sub_category")
    rows = scoped(df, start, end, filters)
    s, p = F.sum("sales"), F.sum("profit")
    margin = F.when(s == 0, F.lit(0.0)).otherwise(
        F.round(p.cast("double") / s.cast("double") * 100, 2))
    g = (rows.groupBy(F.col(breakdown_by).alias("breakdown"), F.col("category"))
             .agg(F.count_distinct("order_id").alias("orders"),
                  F.round(s, 2).cast("double").alias("sales"),
                  F.round(p, 2).cast("double").alias("profit"),
                  F.round(F.sum("discount").cast("double") / F.count("discount") * 100, 1)
                   .alias("avg_discount_pct"),
                  margin.alias("profit_margin"),
                  p.alias("_profit"))
             .filter(F.col("_profit") < 0))
    return limited(g.orderBy(F.col("_profit").asc(), F.col("breakdown").asc_nulls_last(),
                             F.col("category").asc_nulls_last()), top_k).drop("_profit")


def detail_rows(df: DataFrame, breakdown_by: str = "sub_category", start=None, end=None,
                filters=None, cond: str = "profit_negative", n: int = ROW_SAMPLE) -> DataFrame:
    """The ``n`` worst lines (lowest profit) matching the condition.

    ``product_name`` is included when the table has it (the reference retries
    the query without it).  Ties are broken on every output column so the
    result is deterministic; ``orderBy().limit()`` keeps only n rows per task.
    """
    breakdown_by = dimension(breakdown_by or "sub_category")
    rows = scoped(df, start, end, filters).filter(condition(cond))
    cols = [F.col("order_id"), F.col("order_date"), F.col(breakdown_by).alias("breakdown"),
            F.col("category")]
    if "product_name" in df.columns:
        cols.append(F.col("product_name"))
    cols += [F.col("sales"), F.col("profit"), F.col("discount")]
    out = rows.select(*cols)
    order = [F.col("profit").asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in out.columns if c != "profit"]
    return out.orderBy(*order).limit(n)


def loss_reason(df: DataFrame) -> DataFrame:
    """Why a loss group loses: heavy discount (>=30), discount (>=15), structural margin (< -20)."""
    d, m = F.col("avg_discount_pct"), F.col("profit_margin")
    reason = (F.when(d >= 30, "heavy_discount")
               .when(d >= 15, "discount")
               .when(m < -20, "structural_margin"))
    return df.withColumn("loss_reason", reason)


def extremes(result: DataFrame, metric: str, key: str = "breakdown") -> DataFrame:
    """Top n and bottom n rows of a (small) result, n = min(3, max(1, rows // 3)).

    Output rows: side ('top' / 'bottom'), rank within side (bottom listed worst
    first), key, value, plus the gap between highest and lowest and the gap in
    % of the highest.  Needs at least two rows.  Each side is ``orderBy().limit(3)``
    (every task keeps three rows), and only those six are ranked.
    """
    r = result.select(F.col(key).alias("breakdown"), F.col(metric).cast("double").alias("value"))
    rows = r.agg(F.count(F.lit(1)).alias("_rows"))
    down = [F.col("value").desc_nulls_last(), F.col("breakdown").asc_nulls_last()]
    up = [F.col("value").asc_nulls_first(), F.col("breakdown").desc_nulls_first()]
    both = None
    for side, order in (("top", down), ("bottom", up)):
        s = r.orderBy(*order).limit(3).withColumn("side", F.lit(side)).withColumn(
            "rank", F.row_number().over(Window.partitionBy("side").orderBy(*order)).cast("long"))
        both = s if both is None else both.unionByName(s)
    w = Window.partitionBy()  # six rows
    hi = F.max(F.when((F.col("side") == "top") & (F.col("rank") == 1), F.col("value"))).over(w)
    lo = F.max(F.when((F.col("side") == "bottom") & (F.col("rank") == 1), F.col("value"))).over(w)
    n = rows.scalar()
    both = both.withColumn("gap", hi - lo).withColumn(
        "gap_pct", F.when(hi != 0, (hi - lo) / F.abs(hi) * 100).otherwise(F.lit(0.0)))
    return both.filter((n >= 2) & (F.col("rank") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 3))))).select(
        "side", "rank", "breakdown", "value", "gap", "gap_pct")


def detail_totals(summary: DataFrame) -> DataFrame:
    """Totals over the loss groups of ``summary`` (the shown ones, or all for ``detail_summary(top_k=None)``): groups, orders (summed, so an
    order in two groups counts twice, D20), total loss, total sales."""
    return summary.agg(F.count(F.lit(1)).alias("groups"),
                       F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
                       F.coalesce(F.sum(F.col("profit").cast("decimal(38,2)")), F.lit(0)).cast("double")
                        .alias("total_loss"),
                       F.coalesce(F.sum(F.col("sales").cast("decimal(38,2)")), F.lit(0)).cast("double")
                        .alias("total_sales"))


def kpi_detail(df: DataFrame, start=None, end=None, condition: str = "profit_negative",
               breakdown_by: str = "sub_category", top_k: int = 15, filters=None):
    """The drill-down as one call: ``(loss groups with reasons, worst lines)``."""
    summary = loss_reason(detail_summary(df, breakdown_by, start, end, filters, top_k))
    return summary, detail_rows(df, breakdown_by, start, end, filters, cond=condition)
