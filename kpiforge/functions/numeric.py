"""Numeric cleaning and discount buckets (M-b, M-c, M-d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A plain decimal literal after cleaning; anything else (``1.0d``, ``1.2.3``,
# ``abc``) becomes NULL, as a lenient numeric parse with coercion does.
NUMBER_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# fixed values: discount bucket borders and labels (right-closed, first one
# also takes exactly 0)
BUCKET_EDGES = (0.0, 0.1, 0.2, 0.3, 1.0)
BUCKET_LABELS = ("0-10%", "10-20%", "20-30%", ">30%")


def clean_numeric(col: Column) -> Column:
    """Text to DOUBLE: trim, drop ``%``, decimal comma to point; else NULL."""
    s = F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")
    s = F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return F.when(s.rlike(NUMBER_TEXT), s.try_cast("double"))


def normalize_discount(df: DataFrame, col: str = "discount") -> Column:
    """Divide by 100 when the column's maximum is above 1 (stored as percent).

    The maximum is a scalar subquery: computed once, no join and no driver
    round trip.
    """
    mx = df.agg(F.max(col)).scalar()
    return F.when(mx > 1, F.col(col) / 100).otherwise(F.col(col))


def discount_bucket(col: Column) -> Column:
    """Bucket label; outside [0, 1] or NULL gives NULL."""
    e = BUCKET_EDGES
    out = F.when((col >= e[0]) & (col <= e[1]), F.lit(BUCKET_LABELS[0]))
    for i in range(1, len(BUCKET_LABELS)):
        out = out.when((col > e[i]) & (col <= e[i + 1]), F.lit(BUCKET_LABELS[i]))
    return out


def bucket_order(col: Column) -> Column:
    """Sort key of a bucket label (its position in BUCKET_LABELS)."""
    out = F.when(col == BUCKET_LABELS[0], F.lit(0))
    for i, lab in enumerate(BUCKET_LABELS[1:], start=1):
        out = out.when(col == lab, F.lit(i))
    return out
