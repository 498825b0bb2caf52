"""Data behind the eight dashboard charts (B1-B8); drawing is left to the caller.

Like the reference's pandas code these frames drop NULL group keys and rows
whose date did not parse (D17).  Each is a single aggregate over the rows;
for all breakdowns in one scan see :func:`kpiforge.operators.kpi.breakdown_all`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.numeric import bucket_order, clean_numeric, discount_bucket
from kpiforge.operators.filters import valid_dates


def _num(df: DataFrame, col: str):
    """Numeric view of a column: typed columns as is, text cleaned (M-b)."""
    return clean_numeric(F.col(col)) if dict(df.dtypes)[col] == "string" else F.col(col)


def _total(df: DataFrame, col: str):
    """pandas-style group sum: 0 (not NULL) when every value is missing."""
    return F.coalesce(F.sum(_num(df, col)).cast("double"), F.lit(0.0))


def sales_profit_by_month(df: DataFrame) -> DataFrame:
    """B1: monthly sales and profit, oldest first."""
    return (valid_dates(df)
            .groupBy(F.trunc("order_date", "month").alias("order_date"))
            .agg(_total(df, "sales").alias("sales"),
                 _total(df, "profit").alias("profit"))
            .orderBy("order_date"))


def orders_by_month(df: DataFrame) -> DataFrame:
    """B2: distinct orders per month."""
    return (valid_dates(df)
            .groupBy(F.trunc("order_date", "month").alias("order_date"))
            .agg(F.count_distinct("order_id").alias("orders"))
            .orderBy("order_date"))


def profit_by(df: DataFrame, dim: str) -> DataFrame:
    """B3 (region) / B4 (segment): summed profit per value, NULL key dropped."""
    return (df.filter(F.col(dim).isNotNull())
              .groupBy(dim).agg(_total(df, "profit").alias("profit"))
              .orderBy(dim))


def profit_heatmap(df: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Summed profit per segment and region; absent cells NULL.

    With ``regions`` the result has one row per segment and one column per
    region; without, one row per cell (segment, region, profit), because
    columns that depend on the data would need a job before the plan exists.
    """
    base = df.filter(F.col("segment").isNotNull() & F.col("region").isNotNull())
    cells = base.groupBy("segment", "region").agg(F.sum(_num(df, "profit")).cast("double").alias("profit"))
    return _heat_columns(cells, regions)


def _heat_columns(cells: DataFrame, regions: list[str] | None) -> DataFrame:
    """Cells of the heatmap as rows, or spread over the given columns."""
    if not regions:
        return cells.orderBy("segment", "region")
    return (cells.groupBy("segment")
                 .agg(*[F.max(F.when(F.col("region") == r, F.col("profit"))).alias(r) for r in sorted(regions)])
                 .orderBy("segment"))


def discount_groups(discount) -> tuple:
    """Bucket of a discount as it is, and as a percentage (divided by 100)."""
    return (discount_bucket(discount).alias("_raw"), discount_bucket(discount / 100).alias("_pct"))


def discount_impact(df: DataFrame) -> DataFrame:
    """Average sales and profit per discount bucket.

    Discount is cleaned, divided by 100 when its maximum is above 1,
    restricted to [0, 1] and bucketed right-closed: [0, .1], (.1, .2],
    (.2, .3], (.3, 1].  One pass: lines are grouped by both buckets (as it is,
    as a percentage), at most 25 groups, and the maximum over those groups
    says which of the two holds.
    """
    d = _num(df, "discount")
    g = (df.select(*discount_groups(d), d.alias("_d"), _num(df, "sales").alias("sales"), _num(df, "profit").alias("profit"))
           .groupBy("_raw", "_pct")
           .agg(F.max("_d").alias("_mx"), F.sum("sales").alias("s"), F.sum("profit").alias("p"),
                F.count("sales").alias("ns"), F.count("profit").alias("np")))
    percent = F.max("_mx").over(Window.partitionBy()) > 1  # over the 25 groups
    g = g.withColumn("discount_bucket", F.when(percent, F.col("_pct")).otherwise(F.col("_raw")))
    return (g.filter(F.col("discount_bucket").isNotNull()).groupBy("discount_bucket")
             .agg((F.sum("s").cast("double") / F.sum("ns")).alias("avg_sales"),
                  (F.sum("p").cast("double") / F.sum("np")).alias("avg_profit"))
             .orderBy(bucket_order(F.col("discount_bucket"))))


def top_sub_categories(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Sub-categories with the highest summed profit (ties: name order)."""
    g = (df.filter(F.col("sub_category").isNotNull())
           .groupBy("sub_category").agg(_total(df, "profit").alias("profit")))
    return (g.filter(F.col("profit").isNotNull())
             .orderBy(F.col("profit").desc(), F.col("sub_category").asc()).limit(top_n))


def category_share(df: DataFrame) -> DataFrame:
    """Profit per category and its share of the total in % (NULL when total is 0).

    The share window runs over the few category rows only.
    """
    g = (df.filter(F.col("category").isNotNull())
           .groupBy("category").agg(F.sum(_num(df, "profit")).alias("_p")))
    # exact (DECIMAL) total, so the share does not depend on summation order
    total = F.sum("_p").over(Window.partitionBy()).cast("double")
    return (g.select("category", F.col("_p").cast("double").alias("profit"),
                     F.when(total != 0, F.col("_p").cast("double") / total * 100).alias("share_pct"))
             .orderBy("category"))


def dashboard_frames(df: DataFrame, regions: list[str] | None = None) -> dict[str, DataFrame]:
    """All eight chart frames from two passes over the lines instead of eight (S7 re-aimed).

    Building runs no job.  One grouping-sets aggregate (month, region,
    segment, category, sub_category, segment x region, discount buckets) holds
    every sum and count the charts need; it is small (bounded by months and
    dimension values) and persisted because all frames read it.  Orders per
    month need an exact distinct count: the second pass.  Each frame equals
    the one of the single-chart function above (``regions``: columns of the
    heatmap).  The persisted aggregate is returned too (key ``shared``);
    ``unpersist()`` it when the dashboard is refreshed.
    """
    d = F.col("order_date")
    disc = _num(df, "discount")
    base = df.select(F.trunc(d, "month").alias("month"), "region", "segment", "category", "sub_category",
                     *discount_groups(disc), disc.alias("_d"), _num(df, "sales").alias("sales"), _num(df, "profit").alias("profit"))
    keys = ["month", "region", "segment", "category", "sub_category", "_raw", "_pct"]
    sets = [[F.col("month")], [F.col("region")], [F.col("segment")], [F.col("category")],
            [F.col("sub_category")], [F.col("segment"), F.col("region")], [F.col("_raw"), F.col("_pct")]]
    agg = base.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.sum("sales").alias("s"), F.sum("profit").alias("p"), F.max("_d").alias("mx"),
        F.count("sales").alias("ns"), F.count("profit").alias("np"),
        F.grouping_id(*[F.col(k) for k in keys]).alias("_gid")).persist()

    def only(*present, nulls=False):
        m = (1 << len(keys)) - 1
        for k in present:
            m ^= 1 << (len(keys) - 1 - keys.index(k))
        cond = F.col("_gid") == m
        for k in () if nulls else present:  # pandas-style: NULL keys are dropped
            cond = cond & F.col(k).isNotNull()
        return agg.filter(cond)

    def total(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    per_dim = {k: only(k).select(k, total("p").alias("profit")) for k in ("region", "segment", "sub_category")}
    cat = only("category").select("category", F.col("p").alias("_p"))
    share_total = F.sum("_p").over(Window.partitionBy()).cast("double")
    heat = only("segment", "region").select("segment", "region", F.col("p").cast("double").alias("profit"))
    percent = F.max("mx").over(Window.partitionBy()) > 1  # over at most 25 groups
    buckets = only("_raw", "_pct", nulls=True).withColumn("discount_bucket", F.when(percent, F.col("_pct")).otherwise(F.col("_raw")))
    return {
        "shared": agg,
        "sales_profit_by_month": only("month").select(F.col("month").alias("order_date"), total("s").alias("sales"),
                                                      total("p").alias("profit")).orderBy("order_date"),
        "orders_by_month": orders_by_month(df),
        "profit_by_region": per_dim["region"].orderBy("region"),
        "profit_by_segment": per_dim["segment"].orderBy("segment"),
        "profit_heatmap": _heat_columns(heat, regions),
        "discount_impact": buckets.filter(F.col("discount_bucket").isNotNull()).groupBy("discount_bucket").agg(
            (F.sum("s").cast("double") / F.sum("ns")).alias("avg_sales"),
            (F.sum("p").cast("double") / F.sum("np")).alias("avg_profit")).orderBy(bucket_order(F.col("discount_bucket"))),
        "top_sub_categories": per_dim["sub_category"].orderBy(F.col("profit").desc(), F.col("sub_category")).limit(10),
        "category_share": cat.select("category", F.col("_p").cast("double").alias("profit"),
                                     F.when(share_total != 0, F.col("_p").cast("double") / share_total * 100)
                                      .alias("share_pct")).orderBy("category"),
    }
