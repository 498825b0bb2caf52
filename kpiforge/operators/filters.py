"""Row filters and date windows.

Windows are returned as ``(start, end)`` Columns so the same KPI operators
work with literal plan dates and with data-anchored windows ("past 30 days"
ends at the table's latest order date, found by a scalar subquery that Spark
runs once; no join, nothing collected on the driver).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.dates import month_bounds, quarter_bounds, to_date, year_bounds

FILTER_DIMS = ("region", "segment", "category", "sub_category", "state")

# fixed values: named row conditions of the drill-down
CONDITIONS = {
    "profit_negative": lambda: F.col("profit") < 0,
    "loss_orders": lambda: F.col("profit") < 0,
    "profit_positive": lambda: F.col("profit") > 0,
    "high_discount": lambda: F.col("discount") > 0.2,
}

RELATIVE_UNITS = ("day", "week", "month", "year")


def as_date_col(v) -> Column:
    """Literal DATE for python dates / ISO strings; Columns pass through."""
    if isinstance(v, Column):
        return v
    return F.lit(to_date(v))


PARTITION_YEAR = "order_year"


def year_prune(df: DataFrame, start=None, end=None) -> DataFrame:
    """On a wide table written by ``materialize_order_lines`` (partitioned by
    ``order_year``) add the implied year bounds, so the scan skips whole year
    directories; tables without the column pass through."""
    if PARTITION_YEAR not in df.columns:
        return df
    y = F.col(PARTITION_YEAR)
    if start is not None:
        df = df.filter(y >= F.year(as_date_col(start)))
    if end is not None:
        df = df.filter(y <= F.year(as_date_col(end)))
    return df


def date_window(df: DataFrame, start=None, end=None, col: str = "order_date") -> DataFrame:
    """``start <= d <= end``, both ends included; a missing end is open."""
    d = F.col(col)
    if col == "order_date":
        df = year_prune(df, start, end)
    if start is not None and end is not None:
        return df.filter(d.between(as_date_col(start), as_date_col(end)))
    if start is not None:
        return df.filter(d >= as_date_col(start))
    if end is not None:
        return df.filter(d <= as_date_col(end))
    return df


def in_lists(df: DataFrame, filters: dict | None) -> DataFrame:
    """IN-list per dimension, AND between dimensions; empty list = no filter."""
    for dim in FILTER_DIMS:
        vals = (filters or {}).get(dim)
        if vals:
            df = df.filter(F.col(dim).isin([str(v) for v in vals]))
    return df


def condition(name: str) -> Column:
    """boolean Column of a named row condition."""
    if name not in CONDITIONS:
        raise ValueError(f"Invalid condition: {name!r}")
    return CONDITIONS[name]()


def valid_dates(df: DataFrame, col: str = "order_date") -> DataFrame:
    """drop rows whose date did not parse."""
    return df.filter(F.col(col).isNotNull())


def valid_discount(col: Column) -> Column:
    """not NULL and within [0, 1]."""
    return col.isNotNull() & col.between(0, 1)


def anchor_date(df: DataFrame, col: str = "order_date", latest: date | None = None) -> Column:
    """Latest date of the table (J3): the one given (from file statistics, see ``sources.latest_order_date``; windows are then
    literals, which reach the scan), else a scalar subquery, which reads the table once more."""
    return df.agg(F.max(col)).scalar() if latest is None else F.lit(latest)


def relative_window(df: DataFrame, n: int, unit: str, col: str = "order_date", latest: date | None = None) -> tuple[Column, Column]:
    """"past/last N day|week|month|year" ending at the latest date.

    start = anchor - N units; both ends included, so N days span N+1 dates
    (kept as in the reference, D15).
    """
    if unit not in RELATIVE_UNITS:
        raise ValueError(f"Invalid unit: {unit!r}")
    a = anchor_date(df, col, latest)
    if unit == "day":
        start = F.date_sub(a, n)
    elif unit == "week":
        start = F.date_sub(a, 7 * n)
    elif unit == "month":
        start = F.add_months(a, -n)
    else:
        start = F.add_months(a, -12 * n)
    return start, a


def current_window(df: DataFrame, grain: str, col: str = "order_date", latest: date | None = None) -> tuple[Column, Column]:
    """F8: this week / month / quarter / year up to the latest date (week = from Monday)."""
    if grain not in ("week", "month", "quarter", "year"):
        raise ValueError(f"Invalid grain: {grain!r}")
    a = anchor_date(df, col, latest)
    return F.trunc(a, grain), a


def calendar_window(year: int, month: int | None = None, quarter: int | None = None) -> tuple[date, date]:
    """a month of a year, a quarter of a year, or a whole year."""
    if month is not None:
        return month_bounds(year, month)
    if quarter is not None:
        return quarter_bounds(year, quarter)
    return year_bounds(year)


def semi_top(df: DataFrame, top: DataFrame, key: str = "breakdown") -> DataFrame:
    """keep rows whose key is in a (small) top-k frame: a left-semi join."""
    t = top.select(F.col(key).alias("_semi_key")).distinct()
    return df.join(t, df[key].eqNullSafe(t["_semi_key"]), how="left_semi")
