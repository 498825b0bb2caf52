"""Date helpers: period buckets, labels, window arithmetic (D-a..D-e, C3)."""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("week", "month", "quarter", "year")
COMPARE_PERIODS = ("prev_period", "mom", "yoy")


def period_start(col: Column, grain: str) -> Column:
    """First day of the week (ISO Monday) / month / quarter / year, as DATE."""
    if grain not in GRAINS:
        raise ValueError(f"Invalid time_grain: {grain!r}")
    return F.trunc(col, grain)


def period_label(col: Column, grain: str) -> Column:
    """``2014``, ``2014 Q1``, ``2014-01``, ``2014-01-06`` (D-c)."""
    if grain == "year":
        return F.date_format(col, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(col, "yyyy"), F.lit(" Q"), F.quarter(col).cast("string"))
    if grain == "month":
        return F.date_format(col, "yyyy-MM")
    return F.date_format(col, "yyyy-MM-dd")


def context_label(col: Column) -> Column:
    """``Jan 2014``: month and year of a plan's window bounds (D-c)."""
    return F.date_format(col, "MMM yyyy")


def to_date(value) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.strptime(str(value).strip(), "%Y-%m-%d").date()


def shift_months(d: date, months: int) -> date:
    """Calendar month shift that clamps to the month end (2024-03-31 -1 -> 02-29)."""
    idx = d.year * 12 + (d.month - 1) + months
    y, m = divmod(idx, 12)
    last = calendar.monthrange(y, m + 1)[1]
    return date(y, m + 1, min(d.day, last))


def previous_window(start, end, compare_period: str) -> tuple[date, date]:
    """Comparison window (C3): same length before, one month back, one year back."""
    sd, ed = to_date(start), to_date(end)
    if compare_period == "prev_period":
        days = (ed - sd).days + 1
        prev_end = sd - timedelta(days=1)
        return prev_end - timedelta(days=days - 1), prev_end
    if compare_period == "mom":
        return shift_months(sd, -1), shift_months(ed, -1)
    if compare_period == "yoy":
        return shift_months(sd, -12), shift_months(ed, -12)
    raise ValueError(f"Unsupported compare_period: {compare_period!r}")


def previous_window_cols(start: Column, end: Column, compare_period: str) -> tuple[Column, Column]:
    """Column version of :func:`previous_window` (rows carry their own windows)."""
    if compare_period == "prev_period":
        prev_end = F.date_sub(start, 1)
        return F.date_sub(prev_end, F.datediff(end, start)), prev_end
    if compare_period == "mom":
        return F.add_months(start, -1), F.add_months(end, -1)
    if compare_period == "yoy":
        return F.add_months(start, -12), F.add_months(end, -12)
    raise ValueError(f"Unsupported compare_period: {compare_period!r}")


def month_bounds(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def quarter_bounds(year: int, q: int) -> tuple[date, date]:
    first = 3 * (q - 1) + 1
    return date(year, first, 1), month_bounds(year, first + 2)[1]


def year_bounds(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year, 12, 31)
