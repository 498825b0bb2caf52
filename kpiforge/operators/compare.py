"""Period-over-period comparison.

The reference runs two queries (current window, previous window) and merges
them on the client.  Here it is ONE scan over the union of both windows with
conditional aggregates: each metric is computed twice, once under
``in_current`` and once under ``in_previous``.  Overlapping windows (mom over
more than a month) stay correct because a row can count for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.dates import COMPARE_PERIODS, previous_window, previous_window_cols
from kpiforge.functions.metrics import change_pct, metric_agg
from kpiforge.operators.filters import PARTITION_YEAR, as_date_col, in_lists, relative_window
from kpiforge.operators.kpi import dimension, limited, metric_list


def _windows(start, end, compare_period: str) -> tuple[Column, Column, Column, Column]:
    if compare_period not in COMPARE_PERIODS:
        raise ValueError(f"Invalid compare_period: {compare_period!r}")
    if isinstance(start, Column) or isinstance(end, Column):
        cs, ce = as_date_col(start), as_date_col(end)
        ps, pe = previous_window_cols(cs, ce, compare_period)
        return cs, ce, ps, pe
    ps, pe = previous_window(start, end, compare_period)
    return as_date_col(start), as_date_col(end), F.lit(ps), F.lit(pe)


def kpi_compare(df: DataFrame, metric, start, end, compare_period: str,
                breakdown_by: str | None = None, filters: dict | None = None) -> DataFrame:
    """C1 (one row) or C2 (one row per dimension value present now, worst first).

    Columns: [breakdown,] metric, current_start, current_end, prev_start,
    prev_end, current, previous, change_pct.  Missing values count as 0;
    change_pct is NULL when previous is 0 (D4).
    """
    metric = metric_list(metric)
    if len(metric) != 1:
        raise ValueError("kpi_compare supports exactly 1 metric.")
    metric = metric[0]
    breakdown_by = dimension(breakdown_by)
    cs, ce, ps, pe = _windows(start, end, compare_period)
    d = F.col("order_date")
    in_cur, in_prev = d.between(cs, ce), d.between(ps, pe)
    rows = in_lists(df, filters)
    if PARTITION_YEAR in df.columns:  # prune year directories of a materialised table
        y = F.col(PARTITION_YEAR)
        rows = rows.filter(y.between(F.year(F.least(cs, ps)), F.year(F.greatest(ce, pe))))
    rows = rows.filter(in_cur | in_prev)
    aggs = [F.coalesce(metric_agg(metric, in_cur).cast("double"), F.lit(0.0)).alias("current"),
            F.coalesce(metric_agg(metric, in_prev).cast("double"), F.lit(0.0)).alias("previous")]
    bounds = [F.lit(metric).alias("metric"), cs.alias("current_start"), ce.alias("current_end"),
              ps.alias("prev_start"), pe.alias("prev_end")]
    if breakdown_by is None:
        out = rows.agg(*aggs)
        return out.select(*bounds, "current", "previous",
                          change_pct(F.col("current"), F.col("previous")).alias("change_pct"))
    out = (rows.groupBy(F.col(breakdown_by).alias("breakdown"))
               .agg(*aggs, F.count(F.when(in_cur, 1)).alias("_n_current"))
               .filter(F.col("_n_current") > 0))
    return (out.select("breakdown", *bounds, "current", "previous",
                       change_pct(F.col("current"), F.col("previous")).alias("change_pct"))
               .orderBy(F.col("change_pct").asc_nulls_last(), F.col("breakdown").asc_nulls_last()))


def compare_flags(df: DataFrame) -> DataFrame:
    """C4: ``underperforming`` (change < 0) and ``arrow`` (up > 5, down < 0, else flat)."""
    chg = F.col("change_pct")
    arrow = F.when(chg < 0, "down").when(chg > 5, "up").otherwise("flat")
    return df.withColumn("underperforming", F.coalesce(chg < 0, F.lit(False))).withColumn("arrow", arrow)


def rank_by_change(df: DataFrame, metric: str, breakdown_by: str, start, end,
                   compare_period: str, top_k: int | None = 10, filters=None) -> DataFrame:
    """C5 (what the question asks): dimension values with the largest change first."""
    cmp = kpi_compare(df, metric, start, end, compare_period, breakdown_by, filters)
    return limited(cmp.orderBy(F.col("change_pct").desc_nulls_last(), F.col("breakdown").asc_nulls_last()), top_k)


def rank_recent(df: DataFrame, breakdown_by: str, top_k: int | None = 10, days: int = 30,
                filters=None, latest=None) -> DataFrame:
    """C5 (what the reference does, D18): top values by sales of the last ``days`` days."""
    breakdown_by = dimension(breakdown_by)
    start, end = relative_window(df, days, "day", latest=latest)
    rows = in_lists(df, filters).filter(F.col("order_date").between(start, end))
    return limited(rows.groupBy(F.col(breakdown_by).alias("breakdown"))
                       .agg(metric_agg("sales").alias("sales"))
                       .orderBy(F.col("sales").desc_nulls_last(), F.col("breakdown").asc_nulls_last()), top_k)
