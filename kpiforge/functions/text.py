"""Text helpers: number formatting (T-a), tokens (T-b, T-c), truncation (T-d).

``format_number`` rounds half-even on the exact binary value of a double, the
same way Python's ``format(x, ',.0f')`` does, so fact text matches the
reference digit for digit.  ``format_string('%.1f')`` rounds half-up and is
avoided.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[a-z0-9_]+"


def money(col: Column) -> Column:
    """``$1,234`` (the reference's ``f"${x:,.0f}"``)."""
    return F.concat(F.lit("$"), F.format_number(col.cast("double"), 0))


def thousands(col: Column) -> Column:
    """``1,234`` for counts and whole numbers."""
    return F.format_number(col.cast("double"), 0)


def fixed(col: Column, digits: int) -> Column:
    """``f"{x:.Nf}"``: N decimals, no grouping."""
    return F.regexp_replace(F.format_number(col.cast("double"), digits), ",", "")


def signed(col: Column, digits: int) -> Column:
    """``f"{x:+.Nf}"``."""
    body = fixed(col.cast("double"), digits)
    # '+' unless the formatted number already carries a '-' (also for -0.0)
    return F.concat(F.when(body.startswith("-"), F.lit("")).otherwise(F.lit("+")), body)


def truncate(col: Column, n: int, suffix: str = "...") -> Column:
    """First ``n`` characters, plus ``suffix`` when the text was longer."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def unigrams(col: Column) -> Column:
    """Lower-cased ``[a-z0-9_]+`` tokens of a text, in order."""
    toks = F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)
    return F.coalesce(toks, F.array().cast("array<string>"))


def with_bigrams(toks: Column) -> Column:
    """Tokens followed by adjacent pairs joined with ``_`` (same vocabulary)."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n),
                       lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(toks, pairs)


def tokenize(col: Column) -> Column:
    return with_bigrams(unigrams(col))
