"""KPI plans as SQL table functions (S4, Q1-Q4, C1-C3), for users who write SQL only.

``register_sql(spark, lines)`` makes the order lines a view and defines, over
it, functions that return tables::

    SELECT * FROM kpi_rank('sub_category', 'sales', 5, DATE'1997-01-01', DATE'1997-12-31')
    SELECT * FROM kpi_compare('profit', 'region', DATE'2000-01-01', DATE'2000-12-31', 'yoy') WHERE change_pct < 0

They are SQL all the way down: Catalyst puts a function's body in place of the
call, so filters and unused columns reach the scan as in a plain query.  An
unknown dimension, metric, grain or period is an error, not an empty table.  A
window's null start or end is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiforge.functions.dates import COMPARE_PERIODS, GRAINS
from kpiforge.functions.metrics import DIMENSIONS, METRICS

_WINDOW = "first DATE DEFAULT NULL, last DATE DEFAULT NULL"


def _one_of(parameter: str, values, otherwise: str) -> str:
    """``otherwise`` where the parameter is one of the values, else an error that names them."""
    known = ", ".join(f"'{v}'" for v in values)
    return f"IF({parameter} IN ({known}), {otherwise}, raise_error(concat('{parameter}: expected one of {', '.join(values)}; got ', {parameter})))"


def _metrics(condition: str = "true") -> dict[str, str]:
    s, p = (f"CAST(SUM({c}) FILTER (WHERE {condition}) AS DOUBLE)" for c in ("sales", "profit"))
    return {"sales": s, "profit": p, "orders": f"COUNT(DISTINCT order_id) FILTER (WHERE {condition})",
            "profit_margin": f"CASE WHEN {s} = 0 THEN 0D ELSE {p} / {s} * 100 END"}


def _pick(parameter: str, of: dict[str, str]) -> str:
    """The one of several expressions that a parameter names."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items())
    return f"CASE {parameter} {cases} END"


def functions(view: str = "order_lines", prefix: str = "kpi") -> dict[str, str]:
    """Name of each function -> its parameters, columns and body."""
    rows = f"{view} WHERE (first IS NULL OR order_date >= first) AND (last IS NULL OR order_date <= last)"
    every = ", ".join(f"{e} AS {m}" for m, e in _metrics().items())
    columns = "sales DOUBLE, profit DOUBLE, orders BIGINT, profit_margin DOUBLE"
    dimension = _one_of("dimension", DIMENSIONS, _pick("dimension", {d: d for d in DIMENSIONS}))
    metric = _one_of("metric", METRICS, _pick("metric", {m: f"CAST({e} AS DOUBLE)" for m, e in _metrics().items()}))
    period = _one_of("grain", GRAINS, "trunc(order_date, grain)")
    # the window that first..last is compared with
    before = {"prev_period": ("date_sub(first, datediff(last, first) + 1)", "date_sub(first, 1)"),
              "mom": ("add_months(first, -1)", "add_months(last, -1)"), "yoy": ("add_months(first, -12)", "add_months(last, -12)")}
    then_first, then_last = (_one_of("period", COMPARE_PERIODS, _pick("period", {p: w[k] for p, w in before.items()})) for k in (0, 1))
    metrics = {c: f"COALESCE({_one_of('metric', METRICS, _pick('metric', {m: f'CAST({e} AS DOUBLE)' for m, e in _metrics(c).items()}))}, 0D)"
               for c in ("is_now", "is_then")}
    # what depends on a parameter is a column first: aggregates are over columns of the view alone
    named = f"SELECT {dimension} AS breakdown, order_id, sales, profit FROM {rows}"
    timed = f"SELECT CAST({period} AS DATE) AS period, order_id, sales, profit FROM {rows}"
    sided = (f"SELECT {dimension} AS breakdown, order_id, sales, profit, order_date BETWEEN first AND last AS is_now, "
             f"order_date BETWEEN {then_first} AND {then_last} AS is_then FROM {view}")
    return {
        f"{prefix}_value": f"({_WINDOW}) RETURNS TABLE ({columns}) RETURN SELECT {every} FROM {rows}",
        f"{prefix}_by": f"(dimension STRING, {_WINDOW}) RETURNS TABLE (breakdown STRING, {columns}) "
                        f"RETURN SELECT breakdown, {every} FROM ({named}) GROUP BY breakdown",
        f"{prefix}_trend": f"(grain STRING, {_WINDOW}) RETURNS TABLE (period DATE, {columns}) "
                           f"RETURN SELECT period, {every} FROM ({timed}) GROUP BY period",
        # a row for each dimension value is ranked, not a line
        f"{prefix}_rank": f"(dimension STRING, metric STRING, k INT, {_WINDOW}) RETURNS TABLE (breakdown STRING, value DOUBLE, position INT) "
                          "RETURN SELECT * FROM (SELECT breakdown, value, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, breakdown ASC NULLS LAST) "
                          f"AS position FROM (SELECT breakdown, {metric} AS value FROM ({named}) GROUP BY breakdown)) WHERE position <= k",
        f"{prefix}_compare": "(metric STRING, dimension STRING, first DATE, last DATE, period STRING) RETURNS TABLE (breakdown STRING, current DOUBLE, "
                             "previous DOUBLE, change_pct DOUBLE) RETURN SELECT breakdown, current, previous, CASE WHEN previous <> 0 THEN "
                             f"(current - previous) / abs(previous) * 100 END FROM (SELECT breakdown, {metrics['is_now']} AS current, "
                             f"{metrics['is_then']} AS previous, COUNT_IF(is_now) AS n FROM ({sided}) WHERE is_now OR is_then GROUP BY breakdown) WHERE n > 0",
    }


def register_sql(spark: SparkSession, lines: DataFrame, view: str = "order_lines", prefix: str = "kpi") -> list[str]:
    """Define the view and the functions in the session; returns the functions' names."""
    lines.createOrReplaceTempView(view)
    made = functions(view, prefix)
    for name, definition in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return list(made)
