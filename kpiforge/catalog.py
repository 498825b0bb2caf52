"""Registered queries and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the driver's whole tables and
returns a DataFrame.  Column names are identical in the Spark result and the
oracle SQL; doubles come from exact DECIMAL sums or from the same IEEE
operations on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.operators import kpi
from kpiforge.sources.order_lines import latest_order_date, line_tasks, order_lines, order_lines_by_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The wide view as DuckDB SQL, same mapping as kpiforge.sources.order_lines.
ORDER_LINES_CTE = """
WITH order_lines AS (
  SELECT o.o_orderkey AS order_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         r.r_name AS region, n.n_name AS state, c.c_mktsegment AS segment,
         p.p_type AS category, p.p_brand AS sub_category, p.p_name AS product_name,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS sales,
         CAST(CAST(l.l_discount AS DECIMAL(4,2)) * 5 AS DECIMAL(6,2)) AS discount,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              - CAST(l.l_quantity AS DECIMAL(12,2)) * CAST(p.p_retailprice AS DECIMAL(12,2)) * 2
              AS DECIMAL(18,4)) AS profit
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)
"""

# SQL metric expressions matching kpiforge.functions.metrics
SQL_METRIC = {
    "sales": "CAST(SUM(sales) AS DOUBLE)",
    "profit": "CAST(SUM(profit) AS DOUBLE)",
    "orders": "COUNT(DISTINCT order_id)",
    "profit_margin": ("CASE WHEN CAST(SUM(sales) AS DOUBLE) = 0 THEN 0.0 "
                      "ELSE CAST(SUM(profit) AS DOUBLE) / CAST(SUM(sales) AS DOUBLE) * 100 END"),
}


def sql_metrics(metrics, cond: str | None = None) -> str:
    out = []
    for m in metrics:
        e = SQL_METRIC[m]
        if cond:
            e = (e.replace("SUM(sales)", f"SUM(CASE WHEN {cond} THEN sales END)")
                  .replace("SUM(profit)", f"SUM(CASE WHEN {cond} THEN profit END)")
                  .replace("DISTINCT order_id", f"DISTINCT CASE WHEN {cond} THEN order_id END"))
        out.append(f"{e} AS {m}")
    return ", ".join(out)


def register(name: str, sql: str | None = None, with_view: bool = True):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if with_view and body.upper().startswith("WITH "):
                body = ORDER_LINES_CTE + ", " + body[5:]
            elif with_view:
                body = ORDER_LINES_CTE + body
            ORACLE_SQL[name] = body
        return fn
    return deco


def _ol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir)


def _ol_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines_by_order(spark, sf_dir, line_tasks(spark, sf_dir))


# ── Q1 / A7 / S6 / S8 ────────────────────────────────────────────────────

@register("kpi_total", f"""
SELECT COALESCE(CAST(SUM(sales) AS DOUBLE), 0.0) AS total_sales,
       COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS total_profit,
       COUNT(DISTINCT order_id) AS total_orders,
       COALESCE({SQL_METRIC['profit_margin']}, 0.0) AS profit_margin
FROM order_lines""")
def q_kpi_total(spark, sf_dir):
    return kpi.kpi_total(_ol(spark, sf_dir))


# ── Q2: one metric pair per dimension ────────────────────────────────────

_BY_DIM = {
    "by_region": ("region", ["profit", "orders"]),
    "by_segment": ("segment", ["sales", "profit"]),
    "by_category": ("category", ["sales", "profit_margin"]),
    "by_sub_category": ("sub_category", ["profit", "sales"]),
    "by_state": ("state", ["sales", "orders"]),
}


def _make_by_dim(dim, metrics):
    def q(spark, sf_dir):
        return kpi.kpi_value(_ol(spark, sf_dir), metrics, breakdown_by=dim)
    return q


for _name, (_dim, _ms) in _BY_DIM.items():
    register(_name, f"""
SELECT {_dim} AS breakdown, {sql_metrics(_ms)}
FROM order_lines GROUP BY {_dim}""")(_make_by_dim(_dim, _ms))


# ── Q3: trends ───────────────────────────────────────────────────────────

from kpiforge.functions.dates import previous_window  # noqa: E402
from kpiforge.operators import compare, dashboard, detail, insights  # noqa: E402
from kpiforge.operators.filters import relative_window  # noqa: E402

_TRENDS = {
    "trend_week": ("week", ["sales", "orders"], None),
    "trend_month": ("month", ["sales", "profit"], None),
    "trend_quarter": ("quarter", ["profit", "profit_margin"], None),
    "trend_year": ("year", ["sales", "orders"], None),
    "trend_month_by_segment": ("month", ["sales"], "segment"),
}


def _make_trend(grain, metrics, dim):
    def q(spark, sf_dir):
        return kpi.kpi_trend(_ol(spark, sf_dir), metrics, grain, breakdown_by=dim)
    return q


for _name, (_g, _ms, _dim) in _TRENDS.items():
    _bd = f", {_dim} AS breakdown" if _dim else ""
    _gb = ", breakdown" if _dim else ""
    register(_name, f"""
SELECT CAST(date_trunc('{_g}', order_date) AS DATE) AS period{_bd}, {sql_metrics(_ms)}
FROM order_lines GROUP BY period{_gb}""")(_make_trend(_g, _ms, _dim))


@register("orders_by_month", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_date, COUNT(DISTINCT order_id) AS orders
FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1""")
def q_orders_by_month(spark, sf_dir):
    return dashboard.orders_by_month(_ol(spark, sf_dir))


# ── Q4 and filtered / windowed values ────────────────────────────────────

@register("rank_sub_category", f"""
SELECT sub_category AS breakdown, {sql_metrics(['profit', 'sales'])}
FROM order_lines GROUP BY sub_category
ORDER BY profit DESC NULLS LAST, breakdown ASC NULLS LAST LIMIT 5""")
def q_rank_sub_category(spark, sf_dir):
    return kpi.kpi_rank(_ol(spark, sf_dir), ["profit", "sales"], "sub_category", 5)


_IN_FILTERS = {"region": ["ASIA", "EUROPE"], "segment": ["BUILDING", "MACHINERY"]}


@register("filtered_in_lists", f"""
SELECT category AS breakdown, {sql_metrics(['sales', 'profit'])}
FROM order_lines
WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  AND region IN ('ASIA', 'EUROPE') AND segment IN ('BUILDING', 'MACHINERY')
GROUP BY category""")
def q_filtered_in_lists(spark, sf_dir):
    return kpi.kpi_value(_ol(spark, sf_dir), ["sales", "profit"], "1996-01-01", "1998-12-31",
                         breakdown_by="category", filters=_IN_FILTERS)


_ANCHOR = "(SELECT MAX(order_date) FROM order_lines)"


@register("relative_30d", f"""
SELECT region AS breakdown, {sql_metrics(['sales', 'orders'])}
FROM order_lines
WHERE order_date BETWEEN CAST({_ANCHOR} - INTERVAL 30 DAY AS DATE) AND {_ANCHOR}
GROUP BY region""")
def q_relative_30d(spark, sf_dir):
    df = _ol(spark, sf_dir)
    start, end = relative_window(df, 30, "day", latest=latest_order_date(spark, sf_dir))
    return kpi.kpi_value(df, ["sales", "orders"], start, end, breakdown_by="region")


@register("calendar_quarter", f"""
SELECT {sql_metrics(['sales', 'profit'])}
FROM order_lines WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""")
def q_calendar_quarter(spark, sf_dir):
    from kpiforge.operators.filters import calendar_window
    start, end = calendar_window(1998, quarter=1)
    return kpi.kpi_value(_ol(spark, sf_dir), ["sales"], start, end)


# ── C1-C5 ────────────────────────────────────────────────────────────────

def sql_compare(metric, cs, ce, cp, dim=None, flags=False):
    ps, pe = previous_window(cs, ce, cp)
    cur = f"order_date BETWEEN DATE '{cs}' AND DATE '{ce}'"
    prv = f"order_date BETWEEN DATE '{ps}' AND DATE '{pe}'"
    c_expr = sql_metrics([metric], cur).rsplit(" AS ", 1)[0]
    p_expr = sql_metrics([metric], prv).rsplit(" AS ", 1)[0]
    bd = f"{dim} AS breakdown, " if dim else ""
    inner = f"""
SELECT {bd}COALESCE(CAST({c_expr} AS DOUBLE), 0.0) AS "current",
       COALESCE(CAST({p_expr} AS DOUBLE), 0.0) AS previous,
       COUNT(CASE WHEN {cur} THEN 1 END) AS n_cur
FROM order_lines WHERE ({cur}) OR ({prv}){' GROUP BY ' + dim if dim else ''}"""
    extra = ""
    if flags:
        extra = (""", COALESCE(change_pct < 0, false) AS underperforming,
       CASE WHEN change_pct < 0 THEN 'down' WHEN change_pct > 5 THEN 'up' ELSE 'flat' END AS arrow""")
    return f"""
SELECT *{extra} FROM (
SELECT {'breakdown, ' if dim else ''}'{metric}' AS metric, DATE '{cs}' AS current_start, DATE '{ce}' AS current_end,
       DATE '{ps}' AS prev_start, DATE '{pe}' AS prev_end, "current", previous,
       CASE WHEN previous <> 0 THEN ("current" - previous) / abs(previous) * 100 END AS change_pct
FROM ({inner}) t {'WHERE n_cur > 0' if dim else ''}) u"""


_CMP = {
    "compare_yoy": ("sales", "2000-01-01", "2000-12-31", "yoy"),
    "compare_mom": ("profit", "2000-06-01", "2000-06-30", "mom"),
    "compare_prev": ("orders", "2000-01-01", "2000-03-31", "prev_period"),
}


def _make_cmp(metric, cs, ce, cp):
    def q(spark, sf_dir):
        return compare.kpi_compare(_ol(spark, sf_dir), metric, cs, ce, cp)
    return q


for _name, _args in _CMP.items():
    register(_name, sql_compare(*_args))(_make_cmp(*_args))


@register("compare_yoy_by_region", sql_compare("profit", "2000-01-01", "2000-12-31", "yoy", "region", True))
def q_compare_yoy_by_region(spark, sf_dir):
    return compare.compare_flags(compare.kpi_compare(
        _ol(spark, sf_dir), "profit", "2000-01-01", "2000-12-31", "yoy", breakdown_by="region"))


@register("rank_by_change", sql_compare("sales", "2000-01-01", "2000-12-31", "yoy", "sub_category")
          + "\nORDER BY change_pct DESC NULLS LAST, breakdown ASC NULLS LAST LIMIT 5")
def q_rank_by_change(spark, sf_dir):
    return compare.rank_by_change(_ol(spark, sf_dir), "sales", "sub_category", "2000-01-01",
                                  "2000-12-31", "yoy", top_k=5)


@register("rank_recent", f"""
SELECT state AS breakdown, {sql_metrics(['sales'])}
FROM order_lines
WHERE order_date BETWEEN CAST({_ANCHOR} - INTERVAL 30 DAY AS DATE) AND {_ANCHOR}
GROUP BY state ORDER BY sales DESC NULLS LAST, breakdown ASC NULLS LAST LIMIT 10""")
def q_rank_recent(spark, sf_dir):
    return compare.rank_recent(_ol(spark, sf_dir), "state", top_k=10, days=30, latest=latest_order_date(spark, sf_dir))


# ── N1-N3 ────────────────────────────────────────────────────────────────

@register("detail_loss_groups", """
SELECT breakdown, category, orders, sales, profit, avg_discount_pct, profit_margin,
       CASE WHEN avg_discount_pct >= 30 THEN 'heavy_discount' WHEN avg_discount_pct >= 15 THEN 'discount'
            WHEN profit_margin < -20 THEN 'structural_margin' END AS loss_reason
FROM (
SELECT sub_category AS breakdown, category, COUNT(DISTINCT order_id) AS orders,
       CAST(ROUND(SUM(sales), 2) AS DOUBLE) AS sales, CAST(ROUND(SUM(profit), 2) AS DOUBLE) AS profit,
       ROUND(CAST(SUM(discount) AS DOUBLE) / COUNT(discount) * 100, 1) AS avg_discount_pct,
       CASE WHEN SUM(sales) = 0 THEN 0.0
            ELSE ROUND(CAST(SUM(profit) AS DOUBLE) / CAST(SUM(sales) AS DOUBLE) * 100, 2) END AS profit_margin,
       SUM(profit) AS p
FROM order_lines GROUP BY sub_category, category HAVING SUM(profit) < 0
ORDER BY p ASC, breakdown, category LIMIT 15) t""")
def q_detail_loss_groups(spark, sf_dir):
    return detail.loss_reason(detail.detail_summary(_ol_by_order(spark, sf_dir), "sub_category"))


@register("detail_loss_rows", """
SELECT order_id, order_date, sub_category AS breakdown, category, product_name, sales, profit, discount
FROM order_lines WHERE profit < 0
ORDER BY profit, order_id, order_date, breakdown, category, product_name, sales, discount LIMIT 10""")
def q_detail_loss_rows(spark, sf_dir):
    return detail.detail_rows(_ol(spark, sf_dir), "sub_category")


@register("extremes", f"""
WITH r AS (SELECT state AS breakdown, {sql_metrics(['sales'])} FROM order_lines GROUP BY state),
k AS (
  SELECT breakdown, sales AS value, COUNT(*) OVER () AS nrows,
         LEAST(3, GREATEST(1, CAST(floor(COUNT(*) OVER () / 3) AS BIGINT))) AS n,
         ROW_NUMBER() OVER (ORDER BY sales DESC NULLS LAST, breakdown ASC NULLS LAST) AS d,
         ROW_NUMBER() OVER (ORDER BY sales ASC NULLS FIRST, breakdown DESC NULLS FIRST) AS u
  FROM r),
g AS (
  SELECT *, MAX(CASE WHEN d = 1 THEN value END) OVER () - MAX(CASE WHEN u = 1 THEN value END) OVER () AS gap,
         MAX(CASE WHEN d = 1 THEN value END) OVER () AS hi
  FROM k)
SELECT 'top' AS side, d AS rank, breakdown, value, gap,
       CASE WHEN hi <> 0 THEN gap / abs(hi) * 100 ELSE 0.0 END AS gap_pct
FROM g WHERE d <= n AND nrows >= 2
UNION ALL
SELECT 'bottom' AS side, u AS rank, breakdown, value, gap,
       CASE WHEN hi <> 0 THEN gap / abs(hi) * 100 ELSE 0.0 END AS gap_pct
FROM g WHERE u <= n AND nrows >= 2""")
def q_extremes(spark, sf_dir):
    res = kpi.kpi_value(_ol(spark, sf_dir), ["sales"], breakdown_by="state")
    return detail.extremes(res, "sales")


# ── B5-B8: dashboard frames ──────────────────────────────────────────────

_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register("heatmap", f"""
SELECT segment, {', '.join(f"""CAST(SUM(CASE WHEN region = '{r}' THEN profit END) AS DOUBLE) AS "{r}" """ for r in _REGIONS)}
FROM order_lines WHERE segment IS NOT NULL AND region IS NOT NULL GROUP BY segment""")
def q_heatmap(spark, sf_dir):
    return dashboard.profit_heatmap(_ol(spark, sf_dir), list(_REGIONS))


@register("heatmap_cells", """
SELECT segment, region, CAST(SUM(profit) AS DOUBLE) AS profit
FROM order_lines WHERE segment IS NOT NULL AND region IS NOT NULL GROUP BY segment, region""")
def q_heatmap_cells(spark, sf_dir):
    return dashboard.profit_heatmap(_ol(spark, sf_dir))


@register("discount_buckets", """
WITH m AS (SELECT MAX(discount) AS mx FROM order_lines),
n AS (SELECT CASE WHEN (SELECT mx FROM m) > 1 THEN discount / 100 ELSE discount END AS d, sales, profit
      FROM order_lines)
SELECT CASE WHEN d >= 0 AND d <= 0.1 THEN '0-10%' WHEN d > 0.1 AND d <= 0.2 THEN '10-20%'
            WHEN d > 0.2 AND d <= 0.3 THEN '20-30%' WHEN d > 0.3 AND d <= 1.0 THEN '>30%' END AS discount_bucket,
       CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sales,
       CAST(SUM(profit) AS DOUBLE) / COUNT(profit) AS avg_profit
FROM n WHERE d IS NOT NULL AND d BETWEEN 0 AND 1 GROUP BY 1""")
def q_discount_buckets(spark, sf_dir):
    return dashboard.discount_impact(_ol(spark, sf_dir))


@register("top_subcategories", """
SELECT sub_category, COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit
FROM order_lines WHERE sub_category IS NOT NULL GROUP BY sub_category
ORDER BY profit DESC, sub_category LIMIT 10""")
def q_top_subcategories(spark, sf_dir):
    return dashboard.top_sub_categories(_ol(spark, sf_dir), 10)


@register("category_share", """
SELECT category, CAST(p AS DOUBLE) AS profit,
       CASE WHEN CAST(SUM(p) OVER () AS DOUBLE) <> 0
            THEN CAST(p AS DOUBLE) / CAST(SUM(p) OVER () AS DOUBLE) * 100 END AS share_pct
FROM (SELECT category, SUM(profit) AS p FROM order_lines WHERE category IS NOT NULL GROUP BY category) t""")
def q_category_share(spark, sf_dir):
    return dashboard.category_share(_ol(spark, sf_dir))


# ── W1-W16: insights over aggregates ─────────────────────────────────────

def _growth_sql(x):
    return (f"CASE WHEN {x} >= 20 THEN 'strong_growth' WHEN {x} >= 5 THEN 'moderate_growth' "
            f"WHEN {x} < 0 THEN 'decline' ELSE 'flat' END")


@register("yoy_change", f"""
WITH t AS (SELECT CAST(date_trunc('year', order_date) AS DATE) AS period, region AS breakdown,
                  {sql_metrics(['sales'])} FROM order_lines GROUP BY 1, 2),
c AS (SELECT *, LAG(sales) OVER (PARTITION BY breakdown ORDER BY period) AS previous,
             ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY period) AS rn FROM t),
d AS (SELECT *, CASE WHEN previous <> 0 THEN (sales - previous) / abs(previous) * 100 END AS change_pct FROM c)
SELECT period, breakdown, sales, previous, change_pct,
       CASE WHEN rn > 1 THEN {_growth_sql('COALESCE(change_pct, 0.0)')} END AS growth_class
FROM d""")
def q_yoy_change(spark, sf_dir):
    t = kpi.kpi_trend(_ol(spark, sf_dir), ["sales"], "year", breakdown_by="region")
    return insights.period_changes(t, "sales")


def _trend_insight_sql(grain, metric, dim, year_grain):
    cagr = ("CASE WHEN n >= 2 THEN CASE WHEN first_value > 0 THEN CASE WHEN last_value >= 0 THEN "
            "round((pow(last_value / first_value, 1.0 / (n - 1)) - 1) * 100, 6) END ELSE 0.0 END END"
            if year_grain else "CAST(NULL AS DOUBLE)")
    return f"""
WITH t AS (SELECT CAST(date_trunc('{grain}', order_date) AS DATE) AS period, {dim} AS breakdown,
                  {sql_metrics([metric])} FROM order_lines GROUP BY 1, 2),
r AS (SELECT breakdown, period, CAST({metric} AS DOUBLE) AS v,
             ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY period) AS a,
             ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY period DESC) AS z,
             ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY {metric} DESC, period) AS pk,
             ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY {metric} ASC, period) AS tr FROM t),
g AS (SELECT breakdown, COUNT(*) AS n,
             MAX(CASE WHEN a = 1 THEN period END) AS first_period, MAX(CASE WHEN a = 1 THEN v END) AS first_value,
             MAX(CASE WHEN z = 1 THEN period END) AS last_period, MAX(CASE WHEN z = 1 THEN v END) AS last_value,
             MAX(CASE WHEN pk = 1 THEN period END) AS peak_period, MAX(CASE WHEN pk = 1 THEN v END) AS peak_value,
             MAX(CASE WHEN tr = 1 THEN period END) AS trough_period, MAX(CASE WHEN tr = 1 THEN v END) AS trough_value,
             AVG(CASE WHEN z <= 2 THEN v END) AS ra, AVG(CASE WHEN z IN (3, 4) THEN v END) AS pa
      FROM r GROUP BY breakdown),
h AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN first_value <> 0
                     THEN (last_value - first_value) / abs(first_value) * 100 ELSE 0.0 END END AS growth_pct,
             {cagr} AS cagr,
             abs(peak_value - trough_value) AS range,
             CASE WHEN n >= 4 AND pa <> 0 THEN (ra - pa) / abs(pa) * 100 END AS momentum_pct
      FROM g)
SELECT breakdown, n, first_period, first_value, last_period, last_value, peak_period, peak_value,
       trough_period, trough_value,
       CASE WHEN n >= 4 THEN ra END AS recent_avg, CASE WHEN n >= 4 THEN pa END AS prior_avg,
       growth_pct, CASE WHEN n >= 2 THEN abs(last_value - first_value) END AS abs_change,
       CASE WHEN n >= 2 THEN CASE WHEN growth_pct > 0 THEN 'grown' ELSE 'declined' END END AS direction,
       cagr, CASE WHEN cagr >= 10 THEN 'healthy' WHEN cagr >= 5 THEN 'moderate'
                  WHEN cagr IS NOT NULL THEN 'slow' END AS cagr_class,
       range, CASE WHEN peak_value <> 0 THEN range / abs(peak_value) * 100 END AS swing_pct,
       momentum_pct,
       CASE WHEN momentum_pct > 10 THEN 'accelerating' WHEN momentum_pct < -10 THEN 'decelerating'
            WHEN momentum_pct IS NOT NULL THEN 'stable' END AS momentum_class,
       CASE WHEN momentum_pct > 5 THEN 'continued_growth' WHEN momentum_pct < -5 THEN 'slowdown'
            WHEN momentum_pct IS NOT NULL THEN 'steady' END AS outlook
FROM h"""


def _make_trend_insight(grain, metric, dim):
    def q(spark, sf_dir):
        t = kpi.kpi_trend(_ol(spark, sf_dir), [metric], grain, breakdown_by=dim)
        return insights.trend_insights(t, metric, grain)
    return q


for _name, (_g, _m, _d) in {"growth_cagr": ("year", "sales", "region"),
                            "peak_trough": ("month", "profit", "segment"),
                            "momentum": ("quarter", "sales", "category")}.items():
    register(_name, _trend_insight_sql(_g, _m, _d, _g == "year"))(_make_trend_insight(_g, _m, _d))


@register("leader_gap_concentration", """
WITH g AS (SELECT sub_category AS breakdown, SUM(profit) AS p FROM order_lines GROUP BY sub_category),
t AS (SELECT ROW_NUMBER() OVER (ORDER BY p DESC NULLS LAST, breakdown ASC NULLS LAST) AS rank, breakdown,
             CAST(p AS DOUBLE) AS value,
             CASE WHEN CAST(SUM(p) OVER () AS DOUBLE) <> 0
                  THEN CAST(p AS DOUBLE) / CAST(SUM(p) OVER () AS DOUBLE) * 100 ELSE 0.0 END AS share_pct,
             p FROM g),
a AS (SELECT COUNT(*) AS n, CAST(SUM(p) AS DOUBLE) AS total,
             MAX(CASE WHEN rank = 1 THEN breakdown END) AS leader,
             MAX(CASE WHEN rank = 1 THEN value END) AS leader_value,
             MAX(CASE WHEN rank = 1 THEN share_pct END) AS leader_share_pct,
             MAX(CASE WHEN rank = 2 THEN breakdown END) AS runner_up,
             MAX(CASE WHEN rank = 2 THEN value END) AS runner_up_value,
             CAST(SUM(CASE WHEN rank <= 2 THEN p END) AS DOUBLE) AS top2,
             arg_max(breakdown, rank) AS bottom, arg_max(value, rank) AS bottom_value,
             string_agg(CASE WHEN value < 0 THEN breakdown END, ', ' ORDER BY rank) AS loss_values,
             MIN(CASE WHEN value < 0 THEN value END) AS worst_loss
      FROM t)
SELECT n, total, leader, leader_value, leader_share_pct, runner_up, runner_up_value,
       CASE WHEN n >= 4 THEN bottom END AS bottom, CASE WHEN n >= 4 THEN bottom_value END AS bottom_value,
       loss_values, worst_loss,
       CASE WHEN n >= 2 THEN CASE WHEN leader_value <> 0
            THEN abs(leader_value - runner_up_value) / abs(leader_value) * 100 ELSE 0.0 END END AS leader_gap_pct,
       CASE WHEN n >= 2 THEN CASE WHEN leader_value <> 0
            THEN abs(leader_value - runner_up_value) / abs(leader_value) * 100 ELSE 0.0 END END > 40 AS uneven,
       CASE WHEN n >= 3 AND total > 0 THEN top2 / total * 100 END AS top2_pct,
       CASE WHEN n >= 3 AND total > 0 THEN top2 / total * 100 END >= 60 AS concentrated
FROM a""")
def q_leader_gap_concentration(spark, sf_dir):
    g = _ol(spark, sf_dir).groupBy(F.col("sub_category").alias("breakdown")).agg(
        F.sum("profit").alias("profit"))
    return insights.rank_summary(g, "profit")


@register("margin_class", f"""
WITH k AS (SELECT COALESCE(CAST(SUM(sales) AS DOUBLE), 0.0) AS total_sales,
                  COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS total_profit,
                  COUNT(DISTINCT order_id) AS total_orders,
                  COALESCE({SQL_METRIC['profit_margin']}, 0.0) AS profit_margin FROM order_lines),
m AS (SELECT *, CASE WHEN total_sales <> 0 THEN total_profit / total_sales * 100 ELSE 0.0 END AS margin_pct FROM k)
SELECT *, CASE WHEN margin_pct < 5 THEN 'low' WHEN margin_pct > 20 THEN 'strong' ELSE 'normal' END AS margin_class,
       CASE WHEN margin_pct >= 10 THEN 'healthy' ELSE 'tight' END AS profit_health,
       CASE WHEN margin_pct >= 12 THEN 'above' ELSE 'below' END AS vs_benchmark,
       CASE WHEN total_orders <> 0 THEN total_sales / CAST(total_orders AS DOUBLE) ELSE 0.0 END AS avg_order_value,
       total_profit > 0 AS profitable
FROM m""")
def q_margin_class(spark, sf_dir):
    return insights.value_insights(kpi.kpi_total(_ol(spark, sf_dir)))


# ── A20, S6, S8, M-b ─────────────────────────────────────────────────────

@register("grouping_sets_all", f"""
SELECT CASE GROUPING(region, segment, category, sub_category) WHEN 7 THEN 'region' WHEN 11 THEN 'segment'
            WHEN 13 THEN 'category' WHEN 14 THEN 'sub_category' ELSE 'total' END AS dimension,
       CASE GROUPING(region, segment, category, sub_category) WHEN 7 THEN region WHEN 11 THEN segment
            WHEN 13 THEN category WHEN 14 THEN sub_category END AS value,
       {sql_metrics(['sales', 'profit', 'orders', 'profit_margin'])}
FROM order_lines GROUP BY GROUPING SETS ((region), (segment), (category), (sub_category), ())""")
def q_grouping_sets_all(spark, sf_dir):
    tasks = line_tasks(spark, sf_dir)
    return kpi.breakdown_all(order_lines_by_order(spark, sf_dir, tasks), tasks=tasks)


@register("filter_options", """
SELECT array_to_string(list_sort(array_agg(DISTINCT region) FILTER (WHERE region IS NOT NULL)), '|') AS regions,
       array_to_string(list_sort(array_agg(DISTINCT segment) FILTER (WHERE segment IS NOT NULL)), '|') AS segments,
       array_to_string(list_sort(array_agg(DISTINCT category) FILTER (WHERE category IS NOT NULL)), '|')
         AS categories,
       MIN(order_date) AS min_date, MAX(order_date) AS max_date
FROM order_lines""")
def q_filter_options(spark, sf_dir):
    from kpiforge.sources.order_lines import filter_options
    o = filter_options(_ol(spark, sf_dir))
    return o.select(*[F.array_join(c, "|").alias(c) for c in ("regions", "segments", "categories")],
                    "min_date", "max_date")


@register("preview_100", """
SELECT * FROM order_lines
ORDER BY order_date, order_id, ship_date, region, state, segment, category, sub_category, product_name,
         sales, discount, profit LIMIT 100""")
def q_preview_100(spark, sf_dir):
    from kpiforge.sources.order_lines import preview
    return preview(_ol(spark, sf_dir), 100)


@register("clean_numeric", r"""
WITH t AS (
  SELECT l_orderkey, l_linenumber,
         replace(CAST(CAST(l_discount * 100 AS DECIMAL(6,2)) AS VARCHAR), '.', ',') || '%' AS discount_text,
         '  ' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) || ' ' AS tax_text,
         l_returnflag || '.' || l_linestatus AS flag_text
  FROM lineitem),
c AS (
  SELECT *, replace(replace(regexp_replace(discount_text, '^\s+|\s+$', '', 'g'), '%', ''), ',', '.') AS d,
            replace(replace(regexp_replace(tax_text, '^\s+|\s+$', '', 'g'), '%', ''), ',', '.') AS x,
            replace(replace(regexp_replace(flag_text, '^\s+|\s+$', '', 'g'), '%', ''), ',', '.') AS f
  FROM t)
SELECT l_orderkey, l_linenumber, discount_text, tax_text, flag_text,
       CASE WHEN regexp_full_match(d, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(d AS DOUBLE) END
         AS discount_value,
       CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(x AS DOUBLE) END
         AS tax_value,
       CASE WHEN regexp_full_match(f, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(f AS DOUBLE) END
         AS flag_value
FROM c""", with_view=False)
def q_clean_numeric(spark, sf_dir):
    from kpiforge.functions.numeric import clean_numeric
    from kpiforge.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    t = li.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.replace((F.col("l_discount") * 100).cast("decimal(6,2)").cast("string"), F.lit("."), F.lit(",")),
                 F.lit("%")).alias("discount_text"),
        F.concat(F.lit("  "), F.col("l_tax").cast("decimal(4,2)").cast("string"), F.lit(" ")).alias("tax_text"),
        F.concat(F.col("l_returnflag"), F.lit("."), F.col("l_linestatus")).alias("flag_text"))
    return t.select("*", clean_numeric(F.col("discount_text")).alias("discount_value"),
                    clean_numeric(F.col("tax_text")).alias("tax_value"),
                    clean_numeric(F.col("flag_text")).alias("flag_value"))


# ── K4, K8, K9, K13 as numbers ───────────────────────────────────────────

from kpiforge.operators import facts  # noqa: E402


@register("time_range", """
SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date,
       array_to_string(list_sort(list_distinct(list(CAST(year(order_date) AS VARCHAR)))), ', ') AS years,
       COUNT(DISTINCT year(order_date)) AS n_years,
       COUNT(DISTINCT date_trunc('month', order_date)) AS n_months
FROM order_lines WHERE order_date IS NOT NULL""")
def q_time_range(spark, sf_dir):
    return facts.time_range(_ol(spark, sf_dir))


@register("last_8_quarters", """
SELECT CAST(year(q) AS VARCHAR) || 'Q' || CAST(quarter(q) AS VARCHAR) AS quarter, sales, profit FROM (
  SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS q, CAST(SUM(sales) AS DOUBLE) AS sales,
         COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit
  FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY q DESC LIMIT 8) t""")
def q_last_8_quarters(spark, sf_dir):
    return facts.last_quarters(_ol(spark, sf_dir), 8)


@register("best_worst_month", """
WITH m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, SUM(sales) AS s,
                  COALESCE(SUM(profit), 0) AS p
           FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1),
b AS (SELECT m, s, p FROM m ORDER BY s DESC, m ASC LIMIT 1),
w AS (SELECT m, p FROM m ORDER BY p ASC, m ASC LIMIT 1)
SELECT strftime(b.m, '%Y-%m') AS best_month, CAST(b.s AS DOUBLE) AS best_sales, CAST(b.p AS DOUBLE) AS best_profit,
       CASE WHEN w.p < 0 THEN strftime(w.m, '%Y-%m') END AS worst_month,
       CASE WHEN w.p < 0 THEN CAST(w.p AS DOUBLE) END AS worst_profit
FROM b, w""")
def q_best_worst_month(spark, sf_dir):
    return facts.best_worst_month(_ol(spark, sf_dir))


@register("segment_category_top9", """
SELECT * FROM (
  SELECT segment, category, COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit,
         COALESCE(CAST(SUM(sales) AS DOUBLE), 0.0) AS sales,
         ROW_NUMBER() OVER (ORDER BY COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) DESC, segment, category) AS rank
  FROM order_lines WHERE segment IS NOT NULL AND category IS NOT NULL GROUP BY segment, category) t
WHERE rank <= 9""")
def q_segment_category_top9(spark, sf_dir):
    return facts.segment_category_top(_ol(spark, sf_dir), 9)


@register("facts")
def q_facts(spark, sf_dir):
    return facts.build_facts(_ol(spark, sf_dir)).select("chunk_id", "text")


# ── R1-R8: retrieval and conversation windows ────────────────────────────

from kpiforge.operators import history, retrieval  # noqa: E402
from kpiforge.sources.tables import read_table  # noqa: E402


def _sql_tokens(table, id_col, text_col, alias):
    """DuckDB: (id, tok) rows of unigrams + bigrams, as kpiforge.functions.text.tokenize."""
    return f"""
{alias}_u AS (SELECT {id_col} AS id, regexp_extract_all(lower({text_col}), '[a-z0-9_]+') AS u FROM {table}),
{alias}_t AS (SELECT id, list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || '_' || u[i + 1])) AS toks
              FROM {alias}_u)"""


def _tfidf_sql(query_table="benchmark", query_id="item_id", query_text="text", query_cte="",
               doc_table="documents", doc_id="doc_id", doc_text="text"):
    """DuckDB TF-IDF over ``doc_table``; ``query_cte`` may define the query / document tables."""
    return f"""
WITH {query_cte}{_sql_tokens(doc_table, doc_id, doc_text, 'd')},
d_x AS (SELECT id AS doc_id, len(toks) AS n_tok, unnest(toks) AS tok FROM d_t),
tf AS (SELECT doc_id, tok, COUNT(*) / MAX(n_tok) AS tf FROM d_x GROUP BY doc_id, tok),
idf AS (SELECT tok, ln(((SELECT COUNT(*) FROM {doc_table}) + 1) / (COUNT(*) + 1)) + 1 AS idf
        FROM tf GROUP BY tok),
w AS (SELECT doc_id, tok, tf * idf AS wr FROM tf JOIN idf USING (tok)),
p AS (SELECT doc_id, tok, wr / sqrt(SUM(wr * wr) OVER (PARTITION BY doc_id)) AS w FROM w),
{_sql_tokens(query_table, query_id, query_text, 'q')},
q_x AS (SELECT id AS qid, unnest(toks) AS tok FROM q_t),
q_c AS (SELECT qid, tok, COUNT(*) AS c FROM q_x GROUP BY qid, tok),
qv AS (SELECT qid, tok, c * idf AS qr FROM q_c JOIN idf USING (tok)),
qn AS (SELECT qid, tok, qr / sqrt(SUM(qr * qr) OVER (PARTITION BY qid)) AS qw FROM qv),
s AS (SELECT qid, doc_id, round(SUM(qw * w), 7) AS score FROM qn JOIN p USING (tok) GROUP BY qid, doc_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)"""


_TFIDF_SQL = _tfidf_sql()


@register("tfidf_topk", _TFIDF_SQL + """
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10""", with_view=False)
def q_tfidf_topk(spark, sf_dir):
    idx = retrieval.fit_tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.retrieve(idx, read_table(spark, sf_dir, "benchmark"), 10, "item_id", "text")


_PINS = (0, 1, 2)


@register("tfidf_pinned", _TFIDF_SQL + f"""
, hits AS (SELECT qid, doc_id, score, rank AS c FROM r WHERE rank <= 10 AND score >= 0.03),
pins AS (SELECT item_id AS qid, unnest([{', '.join(map(str, _PINS))}]) AS doc_id,
                unnest(range(0, {len(_PINS)})) AS pp FROM benchmark),
m AS (SELECT COALESCE(h.qid, p.qid) AS qid, COALESCE(h.doc_id, p.doc_id) AS doc_id, h.score, h.c, p.pp
      FROM hits h FULL OUTER JOIN pins p ON h.qid = p.qid AND h.doc_id = p.doc_id)
SELECT qid, doc_id, COALESCE(score, 0.0) AS score, pp IS NOT NULL AS pinned,
       ROW_NUMBER() OVER (PARTITION BY qid ORDER BY CASE WHEN pp IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL AND c IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL THEN c END NULLS FIRST,
                          CASE WHEN pp IS NOT NULL THEN pp END NULLS FIRST,
                          score DESC NULLS LAST, c ASC NULLS LAST) AS position
FROM m""", with_view=False)
def q_tfidf_pinned(spark, sf_dir):
    idx = retrieval.fit_tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.retrieve_pinned(idx, read_table(spark, sf_dir, "benchmark"), k=6, min_score=0.03,
                                     pinned_ids=_PINS, qid_col="item_id", text_col="text")


@register("history_window", """
WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, COUNT(*) AS kept_messages, MIN(turn) AS first_kept_turn,
       COALESCE(string_agg(CASE WHEN r <= 10 THEN
           CASE WHEN role = 'user' THEN 'User' ELSE 'Bot' END || ': ' ||
           CASE WHEN length(COALESCE(text, '')) > 200 THEN substring(COALESCE(text, ''), 1, 200) || '...'
                ELSE COALESCE(text, '') END END, chr(10) ORDER BY turn), '') AS summary
FROM k WHERE r <= 16 GROUP BY conv_id""", with_view=False)
def q_history_window(spark, sf_dir):
    return history.history_summary(read_table(spark, sf_dir, "conversations"))


@register("followup_query", """
SELECT * FROM (
  SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question,
         arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer
  FROM conversations GROUP BY conv_id) t
  , LATERAL (SELECT last_question || ' ' || last_answer AS query)
WHERE last_question IS NOT NULL AND last_answer IS NOT NULL""", with_view=False)
def q_followup_query(spark, sf_dir):
    return history.followup_query(read_table(spark, sf_dir, "conversations"))


# ── G1-G10: question-log tagging ─────────────────────────────────────────

from kpiforge.operators import questions  # noqa: E402


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_hits(table):
    items = ", ".join(f"{{'kw': {_q(k)}, 'val': {_q(v)}}}" for k, v in questions.longest_first(table))
    return f"list_transform(list_filter([{items}], lambda x: contains(ql, x.kw)), lambda x: x.val)"


def _sql_parse_date(x):
    parts = f"string_split(regexp_replace({x}, '[/.]', '-', 'g'), '-')"
    a, b, c = f"{parts}[1]", f"{parts}[2]", f"{parts}[3]"

    def z(v):
        return f"CASE WHEN length({v}) < 2 THEN lpad({v}, 2, '0') ELSE {v} END"

    def day(y, m, d):
        return (f"CAST(try_strptime({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || "
                f"lpad(CAST({d} AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE)")

    ai, bi = f"TRY_CAST({a} AS INTEGER)", f"TRY_CAST({b} AS INTEGER)"
    ymd = f"CAST(try_strptime({a} || '-' || {z(b)} || '-' || {z(c)}, '%Y-%m-%d') AS DATE)"
    dmy = f"CASE WHEN {ai} BETWEEN 1 AND 31 AND {bi} BETWEEN 1 AND 12 THEN {day(c, bi, ai)} END"
    mdy = f"CASE WHEN {ai} BETWEEN 1 AND 12 AND {bi} BETWEEN 1 AND 31 THEN {day(c, ai, bi)} END"
    return (f"(CASE WHEN len({parts}) <> 3 THEN NULL WHEN length({a}) = 4 THEN {ymd} "
            f"WHEN length({c}) = 4 THEN COALESCE({dmy}, {mdy}) END)")


def _nz(x):
    return f"NULLIF({x}, '')"


_CONV_QUESTIONS = """q AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, COALESCE(text, '') AS q,
             trim(lower(COALESCE(text, ''))) AS ql FROM conversations WHERE role = 'user')"""


def _question_sql(source=_CONV_QUESTIONS):
    Q = questions
    months = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in Q.MONTHS.items())
    rng1 = _sql_parse_date(_nz(f"regexp_extract(ql, {_q(Q.DATE_RANGE)}, 1)"))
    rng2 = _sql_parse_date(_nz(f"regexp_extract(ql, {_q(Q.DATE_RANGE)}, 2)"))
    dates = (f"list_filter(list_transform(regexp_extract_all(ql, {_q(Q.NUMERIC_DATE)}), "
             f"lambda s: {_sql_parse_date('s')}), lambda d: d IS NOT NULL)")
    mname = (f"lower(COALESCE({_nz(f'regexp_extract(ql, {_q(Q.MONTH_YEAR)}, 1)')}, "
             f"{_nz(f'regexp_extract(ql, {_q(Q.MONTH_YEAR)}, 4)')}))")
    myear = (f"COALESCE({_nz(f'regexp_extract(ql, {_q(Q.MONTH_YEAR)}, 2)')}, "
             f"{_nz(f'regexp_extract(ql, {_q(Q.MONTH_YEAR)}, 3)')})")
    mments = ", ".join(
        f"CASE WHEN len(list_filter(v.{d}, lambda x: regexp_matches(ql, '\\b' || regexp_escape(lower(x)) || '\\b'))) "
        f"< len(v.{d}) THEN list_filter(v.{d}, lambda x: regexp_matches(ql, '\\b' || regexp_escape(lower(x)) || '\\b')) "
        f"ELSE [] END AS m_{d}" for d in Q.VALUE_DIMS)
    subdim = " ".join(
        f"WHEN len(list_filter(v.{d}, lambda x: contains(ql, lower(x)))) > 0 AND "
        f"len(list_filter(v.{d}, lambda x: contains(ql, lower(x)))) < len(v.{d}) THEN '{d}'"
        for d in ("sub_category", "region", "segment", "category"))
    return f"""
WITH v AS (SELECT {', '.join(f"list_sort(list_distinct(list({d}) FILTER (WHERE {d} IS NOT NULL))) AS {d}"
                              for d in Q.VALUE_DIMS)},
                  MIN(order_date) AS lo, MAX(order_date) AS hi FROM order_lines),
{source},
a AS (
  SELECT q.*, v.lo, v.hi,
         regexp_matches(q, {_q(Q.DETAIL_NEGATIVE)}) AS is_loss,
         regexp_matches(q, {_q(Q.EXTREMES)}) AS is_extremes,
         regexp_matches(q, {_q(Q.GROWTH_RANK)}) AS is_growth_rank,
         list_filter({_sql_hits(Q.METRIC_KEYWORDS)}, lambda x, i: list_position({_sql_hits(Q.METRIC_KEYWORDS)}, x) = i)
           AS mk,
         {_sql_hits(Q.BREAKDOWN_KEYWORDS)}[1] AS kw_dim,
         CASE WHEN {rng1} IS NOT NULL AND {rng2} IS NOT NULL
              THEN {{'start': least({rng1}, {rng2}), 'end': greatest({rng1}, {rng2})}} END AS w_rng,
         {dates} AS nd,
         CASE WHEN {mname} IS NOT NULL AND {myear} IS NOT NULL
              THEN make_date(CAST({myear} AS INTEGER), CASE {mname} {months} END, 1) END AS m_start,
         {_nz(f"regexp_extract(ql, {_q(Q.QUARTER_YEAR)}, 1)")} AS qn,
         regexp_extract(ql, {_q(Q.QUARTER_YEAR)}, 2) AS qy,
         regexp_extract_all(ql, {_q(Q.TIME_YEAR)}, 1) AS yrs,
         TRY_CAST({_nz(f"regexp_extract(ql, {_q(Q.RELATIVE)}, 1)")} AS INTEGER) AS rel_n,
         lower(regexp_extract(ql, {_q(Q.RELATIVE)}, 2)) AS rel_unit,
         lower(regexp_extract(ql, {_q(Q.RELATIVE)}, 4)) AS rel_grain,
         {mments},
         CASE WHEN regexp_extract(q, {_q(Q.BREAKDOWN_PHRASE)}, 2) = '' THEN NULL ELSE
           CASE WHEN contains(regexp_replace(lower(regexp_extract(q, {_q(Q.BREAKDOWN_PHRASE)}, 2)), '[ -]', '_', 'g'), 'sub')
                THEN 'sub_category'
                ELSE regexp_replace(lower(regexp_extract(q, {_q(Q.BREAKDOWN_PHRASE)}, 2)), '[ -]', '_', 'g') END END AS raw_dim,
         CASE {subdim} END AS value_dim,
         TRY_CAST({_nz(f"regexp_extract(ql, {_q(Q.TOP_N)}, 1)")} AS INTEGER) AS top_n,
         {_sql_hits(Q.GRAIN_KEYWORDS)}[1] AS grain_kw,
         {_sql_hits(Q.COMPARE_KEYWORDS)}[1] AS cmp_kw
  FROM q, v),
b AS (
  SELECT *,
         CASE WHEN len(mk) = 0 THEN ['sales'] ELSE mk[1:2] END AS metrics,
         COALESCE(kw_dim, CASE WHEN raw_dim IN ('region', 'segment', 'category', 'sub_category', 'state') THEN raw_dim END) AS asked_dim,
         COALESCE(kw_dim, CASE WHEN raw_dim IN ('region', 'segment', 'category', 'sub_category', 'state') THEN raw_dim END,
                  value_dim) AS dim,
         COALESCE(w_rng,
                  CASE WHEN len(nd) = 2 THEN {{'start': least(nd[1], nd[2]), 'end': greatest(nd[1], nd[2])}} END,
                  CASE WHEN len(nd) = 1 THEN {{'start': nd[1], 'end': nd[1]}} END,
                  CASE WHEN m_start IS NOT NULL THEN {{'start': m_start, 'end': last_day(m_start)}} END,
                  CASE WHEN qn IS NOT NULL THEN {{'start': make_date(CAST(qy AS INTEGER), (CAST(qn AS INTEGER) - 1) * 3 + 1, 1),
                       'end': last_day(make_date(CAST(qy AS INTEGER), (CAST(qn AS INTEGER) - 1) * 3 + 3, 1))}} END,
                  CASE WHEN len(yrs) = 1 THEN {{'start': make_date(CAST(yrs[1] AS INTEGER), 1, 1),
                       'end': make_date(CAST(yrs[1] AS INTEGER), 12, 31)}} END) AS w_explicit,
         CASE WHEN rel_n IS NOT NULL THEN
                CASE rel_unit WHEN 'day' THEN CAST(hi - rel_n * INTERVAL 1 DAY AS DATE)
                              WHEN 'week' THEN CAST(hi - rel_n * 7 * INTERVAL 1 DAY AS DATE)
                              WHEN 'month' THEN CAST(hi - rel_n * INTERVAL 1 MONTH AS DATE)
                              WHEN 'year' THEN CAST(hi - rel_n * 12 * INTERVAL 1 MONTH AS DATE) END
              WHEN rel_grain <> '' THEN CAST(date_trunc(rel_grain, hi) AS DATE) END AS rel_start
  FROM a),
c AS (
  SELECT *,
         COALESCE(w_explicit, CASE WHEN rel_start IS NOT NULL THEN {{'start': rel_start, 'end': hi}} END) AS dts,
         COALESCE(top_n, CASE WHEN regexp_matches(q, {_q(Q.SUPERLATIVE)}) AND asked_dim IS NOT NULL THEN 1 END) AS tp,
         COALESCE(cmp_kw, CASE WHEN regexp_matches(ql, {_q(Q.COMPARE_WORD)}) THEN 'prev_period' END) AS cmp
  FROM b),
d AS (
  SELECT *,
         CASE WHEN dts IS NOT NULL AND regexp_matches(q, {_q(Q.THIS_PERIOD)}) THEN NULL ELSE grain_kw END AS grn,
         CASE WHEN is_loss THEN 'detail' WHEN is_growth_rank AND dim IS NOT NULL THEN 'growth'
              WHEN cmp = 'yoy' AND dts IS NULL AND regexp_matches(q, {_q(Q.GENERAL_YOY)}) THEN 'yoy_general'
              WHEN cmp = 'yoy' AND dts IS NULL THEN 'yoy' WHEN cmp = 'mom' THEN 'mom' END AS path
  FROM c),
e AS (
  SELECT *,
         CASE WHEN is_loss THEN 'kpi_detail' WHEN is_growth_rank AND dim IS NOT NULL THEN 'kpi_rank'
              WHEN cmp = 'yoy' AND dts IS NULL THEN 'kpi_trend' WHEN cmp = 'mom' THEN 'kpi_trend'
              WHEN cmp IS NOT NULL THEN 'kpi_compare' WHEN tp IS NOT NULL AND dim IS NOT NULL THEN 'kpi_rank'
              WHEN grn IS NOT NULL THEN 'kpi_trend' WHEN dim IS NOT NULL THEN 'kpi_value'
              WHEN dts IS NOT NULL OR len(metrics) > 1 THEN 'kpi_value' END AS intent
  FROM d),
f AS (
  SELECT *,
         CASE WHEN path = 'detail' THEN ['sales', 'profit'] WHEN path = 'growth' THEN ['sales']
              WHEN path IN ('yoy_general', 'yoy', 'mom') OR intent = 'kpi_compare' THEN metrics[1:1]
              ELSE metrics END AS out_metrics,
         COALESCE(CASE WHEN path = 'detail' THEN COALESCE(kw_dim, 'sub_category')
                       WHEN path IN ('yoy_general', 'mom') THEN NULL
                       WHEN intent IN ('kpi_value', 'kpi_trend', 'kpi_rank', 'kpi_compare') THEN dim END,
                  CASE WHEN intent IN ('kpi_value', 'kpi_trend') THEN
                       CASE WHEN len(m_region) > 0 THEN 'region' WHEN len(m_segment) > 0 THEN 'segment'
                            WHEN len(m_category) > 0 THEN 'category' WHEN len(m_sub_category) > 0 THEN 'sub_category' END
                  END) AS out_dim,
         CASE WHEN path = 'detail' THEN w_explicit
              WHEN path = 'growth' AND dts IS NULL THEN {{'start': CAST(hi - 30 * INTERVAL 1 DAY AS DATE), 'end': hi}}
              ELSE dts END AS win
  FROM e)
SELECT id, q AS text, intent,
       CASE WHEN intent IS NOT NULL THEN array_to_string(out_metrics, ',') END AS metrics,
       CASE WHEN intent IS NOT NULL THEN out_dim END AS breakdown,
       CASE WHEN path IN ('yoy_general', 'yoy') THEN 'year' WHEN path = 'mom' THEN 'month'
            WHEN intent = 'kpi_trend' THEN grn END AS time_grain,
       CASE WHEN intent = 'kpi_compare' THEN cmp END AS compare_period,
       CAST(CASE WHEN path = 'detail' THEN 15 WHEN path = 'growth' THEN COALESCE(tp, 10)
                 WHEN intent = 'kpi_rank' THEN tp END AS INTEGER) AS top_k,
       COALESCE(win.start, lo) AS start_date, COALESCE(win."end", hi) AS end_date,
       is_loss, is_extremes, is_growth_rank,
       array_to_string(m_region, '|') AS mentioned_region, array_to_string(m_segment, '|') AS mentioned_segment,
       array_to_string(m_category, '|') AS mentioned_category,
       array_to_string(m_sub_category, '|') AS mentioned_sub_category,
       CASE WHEN is_loss OR ql = '' OR regexp_matches(q, {_q(Q.BREAKDOWN_PHRASE)}) OR regexp_matches(ql, {_q(Q.TIME_YEAR)})
                 OR regexp_matches(ql, {_q(Q.TIME_YM)}) OR regexp_matches(ql, {_q(Q.TIME_GRAIN)})
                 OR regexp_matches(ql, {_q(Q.TIME_REL)}) OR regexp_matches(ql, {_q(Q.NUMERIC_DATE)}) THEN NULL
            WHEN regexp_matches(ql, {_q(Q.FAST_SUMMARY)}) THEN 'summary'
            WHEN regexp_matches(ql, {_q(Q.FAST_SALES)}) THEN 'total_sales'
            WHEN regexp_matches(ql, {_q(Q.FAST_PROFIT)}) THEN 'total_profit'
            WHEN regexp_matches(ql, {_q(Q.FAST_ORDERS)}) THEN 'total_orders'
            WHEN regexp_matches(ql, {_q(Q.FAST_MARGIN)}) THEN 'margin' END AS fast_kpi
FROM f"""


def _flat_tags(t):
    """Flat output for the check: lists as delimited strings."""
    return t.select("id", "text", "intent", F.array_join("metrics", ",").alias("metrics"),
                    *[c for c in t.columns if c not in ("id", "text", "intent", "metrics")
                      and not c.startswith("mentioned_")],
                    *[F.array_join(f"mentioned_{d}", "|").alias(f"mentioned_{d}") for d in questions.VALUE_DIMS])


@register("question_tags", _question_sql())
def q_question_tags(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    qs = conv.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return _flat_tags(questions.tag_questions(qs, _ol(spark, sf_dir)))


# Questions composed from the tables: one per customer, its form chosen by the key, naming the customer's region and
# segment, the type and brand of the part with the same key, and years and days that follow the key.
_QUESTION_FORMS = (
    "'best sales in ' || r_name", "'highest profit for ' || c_mktsegment", "'total sales'", "'total profit'", "'number of orders'",
    "'profit margin'", "'dashboard overview'", "'profit by region'", "'top 3 sub-categories by profit'",
    "'sales in Q' || CAST(1 + c_custkey % 4 AS VARCHAR(1)) || ' ' || y", "'sales 13/02/' || y || ' to 01/02/' || y",
    "'which products are losing money'", "'sales past 30 days'", "'orders last 2 weeks'", "'profit past 3 months'", "'revenue last 1 year'",
    "'sales this quarter'", "'sales this week'", "'profit current month'", "'sales this year'", "'profit vs last year'",
    "'sales month over month'", "'how did sales change year-over-year'", "'compare sales in ' || y || ' vs previous period by segment'",
    "'highest and lowest state by sales'", "'sales and profit of ' || p_type", "'monthly profit for ' || p_brand",
    "'sales on ' || y || '-05-06'", "'sales between 5/6/' || y || ' and 7.8.' || y", "'sales in march ' || y", "y || ' december orders'",
    "'strongest growth by segment'", "'which region has fastest growth in ' || y", "'weekly orders'", "'best region by profit'",
    "'sales in ' || r_name || ' and ' || c_mktsegment || ' for ' || y", "'most profit in ' || r_name || ' by category'",
    "'quarterly sales of ' || c_mktsegment", "'at least sales'", "'compare profit of ' || r_name || ' and others'",
    "'yoy growth of orders in ' || y", "'which orders are at a loss in ' || y", "'   '", "'unprofitable ' || p_brand || ' by state'",
)
_FORMS_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR(20)) AS id, CASE c_custkey % {len(_QUESTION_FORMS)}
       {' '.join(f'WHEN {k} THEN {form}' for k, form in enumerate(_QUESTION_FORMS))} END AS text
FROM (SELECT c_custkey, c_mktsegment, r_name, p_type, p_brand, CAST(1998 + c_custkey % 5 AS VARCHAR(4)) AS y
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      JOIN part ON p_partkey = c_custkey) t"""


@register("question_forms", _question_sql(
    f"q AS (SELECT id, COALESCE(text, '') AS q, trim(lower(COALESCE(text, ''))) AS ql FROM ({_FORMS_SQL}) f)"))
def q_question_forms(spark, sf_dir):
    """Every rule at work: all intents, flags, date forms and mentions occur among the composed questions."""
    tables = {t: read_table(spark, sf_dir, t) for t in ("customer", "nation", "region", "part")}
    sql = _FORMS_SQL
    for t in tables:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return _flat_tags(questions.tag_questions(spark.sql(sql, **tables), _ol(spark, sf_dir)))


# ── remaining single operators: chart frames, conditions, windows, W13/W14, R6, S4 ──

@register("chart_sales_profit_by_month", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_date,
       COALESCE(CAST(SUM(sales) AS DOUBLE), 0.0) AS sales, COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit
FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1""")
def q_chart_sales_profit_by_month(spark, sf_dir):
    return dashboard.sales_profit_by_month(_ol(spark, sf_dir))


@register("chart_profit_by_region", """
SELECT region, COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit
FROM order_lines WHERE region IS NOT NULL GROUP BY region""")
def q_chart_profit_by_region(spark, sf_dir):
    return dashboard.profit_by(_ol(spark, sf_dir), "region")


@register("chart_profit_by_segment", """
SELECT segment, COALESCE(CAST(SUM(profit) AS DOUBLE), 0.0) AS profit
FROM order_lines WHERE segment IS NOT NULL GROUP BY segment""")
def q_chart_profit_by_segment(spark, sf_dir):
    return dashboard.profit_by(_ol(spark, sf_dir), "segment")


@register("detail_high_discount_rows", """
SELECT order_id, order_date, region AS breakdown, category, product_name, sales, profit, discount
FROM order_lines WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND discount > 0.2
ORDER BY profit, order_id, order_date, breakdown, category, product_name, sales, discount LIMIT 10""")
def q_detail_high_discount_rows(spark, sf_dir):
    return detail.detail_rows(_ol(spark, sf_dir), "region", "1998-01-01", "1998-12-31", cond="high_discount")


@register("current_quarter", f"""
SELECT segment AS breakdown, {sql_metrics(['sales', 'profit_margin'])}
FROM order_lines
WHERE order_date BETWEEN CAST(date_trunc('quarter', {_ANCHOR}) AS DATE) AND {_ANCHOR}
GROUP BY segment""")
def q_current_quarter(spark, sf_dir):
    from kpiforge.operators.filters import current_window
    df = _ol(spark, sf_dir)
    start, end = current_window(df, "quarter", latest=latest_order_date(spark, sf_dir))
    return kpi.kpi_value(df, ["sales", "profit_margin"], start, end, breakdown_by="segment")


@register("last_24_top5", f"""
WITH t AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, sub_category AS breakdown,
                  {sql_metrics(['sales'])} FROM order_lines GROUP BY 1, 2),
r AS (SELECT * FROM t WHERE period IN (SELECT DISTINCT period FROM t ORDER BY period DESC LIMIT 24)),
b AS (SELECT breakdown FROM r GROUP BY breakdown ORDER BY SUM(CAST(sales AS DECIMAL(38,10))) DESC, breakdown LIMIT 5)
SELECT * FROM r WHERE breakdown IN (SELECT breakdown FROM b)""")
def q_last_24_top5(spark, sf_dir):
    t = kpi.kpi_trend(_ol(spark, sf_dir), ["sales"], "month", breakdown_by="sub_category")
    return insights.last_periods_top(t, "sales", 24, 5)


@register("compare_insights", f"""
SELECT * EXCLUDE (chg), CASE WHEN chg > 0 THEN 'increased' WHEN chg IS NOT NULL THEN 'decreased' END AS direction,
       abs(chg) AS abs_change_pct,
       CASE WHEN abs(chg) >= 50 THEN 'structural' WHEN abs(chg) >= 30 THEN 'notable'
            WHEN abs(chg) >= 10 THEN 'meaningful' WHEN chg IS NOT NULL THEN 'modest' END AS magnitude,
       CASE WHEN chg IS NOT NULL THEN abs("current" - previous) END AS abs_delta
FROM (SELECT *, CASE WHEN previous <> 0 THEN ("current" - previous) / abs(previous) * 100 END AS chg
      FROM ({sql_compare("sales", "2000-01-01", "2000-12-31", "yoy", "category")}) v) w""")
def q_compare_insights(spark, sf_dir):
    c = compare.kpi_compare(_ol(spark, sf_dir), "sales", "2000-01-01", "2000-12-31", "yoy", breakdown_by="category")
    return insights.compare_insights(c)


@register("sql_params", """
SELECT region, COUNT(DISTINCT order_id) AS orders, CAST(SUM(sales) AS DOUBLE) AS sales
FROM order_lines WHERE order_date >= DATE '1997-01-01' AND order_date <= DATE '1997-12-31'
  AND segment IN ('AUTOMOBILE', 'HOUSEHOLD') GROUP BY region""")
def q_sql_params(spark, sf_dir):
    from kpiforge.sources.order_lines import run_sql
    return run_sql(spark, _ol(spark, sf_dir), """
        SELECT region, COUNT(DISTINCT order_id) AS orders, CAST(SUM(sales) AS DOUBLE) AS sales
        FROM order_lines WHERE order_date >= :start AND order_date <= :end AND segment IN (:s1, :s2)
        GROUP BY region""", {"start": date(1997, 1, 1), "end": date(1997, 12, 31),
                             "s1": "AUTOMOBILE", "s2": "HOUSEHOLD"})


@register("tfidf_context", _TFIDF_SQL + """
, top AS (SELECT qid, doc_id, rank FROM r WHERE rank <= 6)
SELECT top.qid, '
[Verified data facts from dashboard]
' || string_agg('  - ' || d.text, chr(10) ORDER BY top.rank) AS context
FROM top JOIN documents d ON d.doc_id = top.doc_id GROUP BY top.qid""", with_view=False)
def q_tfidf_context(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    idx = retrieval.fit_tfidf(docs, "doc_id", "text")
    ranked = retrieval.retrieve(idx, read_table(spark, sf_dir, "benchmark"), 6, "item_id", "text")
    return retrieval.context_block(ranked.withColumnRenamed("rank", "position"), docs, "doc_id", "text")


# ── K1-K13 fact text ─────────────────────────────────────────────────────

def _m(x):
    return f"'$' || format('{{:,.0f}}', CAST(COALESCE({x}, 0) AS DOUBLE))"


_FACTS_SQL = f"""
WITH mx AS (SELECT MAX(discount) AS mx FROM order_lines),
bk AS (SELECT sales, profit,
              CASE WHEN d >= 0 AND d <= 0.1 THEN '0-10%' WHEN d > 0.1 AND d <= 0.2 THEN '10-20%'
                   WHEN d > 0.2 AND d <= 0.3 THEN '20-30%' WHEN d > 0.3 AND d <= 1.0 THEN '>30%' END AS bucket
       FROM (SELECT sales, profit, CASE WHEN (SELECT mx FROM mx) > 1 THEN discount / 100 ELSE discount END AS d
             FROM order_lines) t),
tot AS (SELECT CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS ts, CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS tp,
               COUNT(DISTINCT order_id) AS o, MIN(order_date) AS lo, MAX(order_date) AS hi FROM order_lines),
yr AS (SELECT year(order_date) AS y, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS s,
              CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS p, COUNT(DISTINCT order_id) AS o
       FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1),
yl AS (SELECT *, LAG(y) OVER (ORDER BY y) AS py, LAG(s) OVER (ORDER BY y) AS ps, LAG(p) OVER (ORDER BY y) AS pp
       FROM yr),
mo AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS s,
              CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS p FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1),
qu AS (SELECT * FROM (SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS q,
              CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS s, CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS p
       FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1) t ORDER BY q DESC LIMIT 8),
dims AS (
  SELECT 'region' AS dim, region AS v, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS s,
         CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS p FROM order_lines WHERE region IS NOT NULL GROUP BY region
  UNION ALL SELECT 'segment', segment, CAST(COALESCE(SUM(sales), 0) AS DOUBLE), CAST(COALESCE(SUM(profit), 0) AS DOUBLE)
  FROM order_lines WHERE segment IS NOT NULL GROUP BY segment
  UNION ALL SELECT 'category', category, CAST(COALESCE(SUM(sales), 0) AS DOUBLE), CAST(COALESCE(SUM(profit), 0) AS DOUBLE)
  FROM order_lines WHERE category IS NOT NULL GROUP BY category
  UNION ALL SELECT 'sub_category', sub_category, CAST(COALESCE(SUM(sales), 0) AS DOUBLE),
         CAST(COALESCE(SUM(profit), 0) AS DOUBLE) FROM order_lines WHERE sub_category IS NOT NULL GROUP BY sub_category),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dim ORDER BY p DESC, v) AS rp,
                  ROW_NUMBER() OVER (PARTITION BY dim ORDER BY s DESC, v) AS rs FROM dims),
topk AS (SELECT * FROM (VALUES ('sub_category', 10), ('category', 5), ('region', 4)) t(dim, k)),
disc AS (SELECT bucket, CAST(SUM(profit) AS DOUBLE) / COUNT(profit) AS ap, CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS av,
                COUNT(profit) AS n
         FROM bk WHERE bucket IS NOT NULL GROUP BY bucket HAVING COUNT(profit) > 0),
sc AS (SELECT * FROM (SELECT segment, category, CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS p
       FROM order_lines WHERE segment IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2) t
       ORDER BY p DESC, segment, category LIMIT 9)
SELECT 'schema_metrics' AS chunk_id, 'Queryable metrics: sales (total revenue USD), profit (can be negative), orders (COUNT DISTINCT order_id), profit_margin (profit/sales × 100, %).' AS text
UNION ALL SELECT 'schema_dimensions', 'Supported breakdowns: region, segment, category, sub_category. Time grains: week, month, quarter, year.'
UNION ALL SELECT 'schema_compare', 'Period comparisons: yoy (vs same period last year), mom (vs prior month), prev_period (vs prior window of equal length).'
UNION ALL SELECT 'schema_intents', 'Supported query intents: kpi_value (aggregates), kpi_trend (time series), kpi_rank (top-k by dimension), kpi_compare (period-over-period).'
UNION ALL SELECT 'filter_context', 'Current dashboard filters: Date range: full history.'
UNION ALL SELECT 'kpi_summary', 'KPI summary (current filters): Total Sales=' || {_m('ts')} || ', Total Profit=' || {_m('tp')}
  || ', Total Orders=' || format('{{:,}}', o) || ', Profit Margin='
  || format('{{:.2f}}', CASE WHEN ts <> 0 THEN tp / ts * 100 ELSE 0.0 END) || '%.' FROM tot
UNION ALL SELECT 'kpi_profitability', 'Net profit ' || {_m('tp')} || ' on revenue ' || {_m('ts')} || ' → margin '
  || format('{{:.2f}}', CASE WHEN ts <> 0 THEN tp / ts * 100 ELSE 0.0 END) || '%. '
  || CASE WHEN tp > 0 THEN 'Profitable.' ELSE 'Operating at a loss.' END FROM tot
UNION ALL SELECT 'time_range', 'Data spans ' || CAST(lo AS VARCHAR) || ' to ' || CAST(hi AS VARCHAR) || '. '
  || (SELECT COUNT(*) FROM yr) || ' years: [' || (SELECT string_agg(CAST(y AS VARCHAR), ', ' ORDER BY y) FROM yr)
  || ']. ' || (SELECT COUNT(*) FROM mo) || ' months total.' FROM tot WHERE lo IS NOT NULL
UNION ALL SELECT 'yearly_' || y, 'Year ' || y || ': Sales=' || {_m('s')} || ', Profit=' || {_m('p')} || ', Orders='
  || format('{{:,}}', o) || ', Margin=' || format('{{:.1f}}', CASE WHEN s <> 0 THEN p / s * 100 ELSE 0.0 END) || '%.'
  FROM yr
UNION ALL SELECT 'yoy_comparison', 'Year-over-year changes: ' || string_agg(py || '→' || y || ': Sales '
  || format('{{:+.1f}}', CASE WHEN ps <> 0 THEN (s - ps) / ps * 100 ELSE 0.0 END) || '%, Profit '
  || format('{{:+.1f}}', CASE WHEN pp <> 0 THEN (p - pp) / abs(pp) * 100 ELSE 0.0 END) || '%', '; ' ORDER BY y) || '.'
  FROM yl WHERE py IS NOT NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'yearly_growth', 'Revenue growth ' || MIN(y) || '→' || MAX(y) || ': '
  || format('{{:+.1f}}', CASE WHEN arg_min(s, y) <> 0 THEN (arg_max(s, y) - arg_min(s, y)) / arg_min(s, y) * 100 ELSE 0.0 END)
  || '% (' || {_m('arg_min(s, y)')} || ' → ' || {_m('arg_max(s, y)')} || ').' FROM yr HAVING COUNT(*) >= 2
UNION ALL SELECT 'monthly_best_sales', 'Peak month by sales: ' || strftime(m, '%Y-%m') || ' — ' || {_m('s')}
  || ', profit ' || {_m('p')} || '.' FROM (SELECT * FROM mo ORDER BY s DESC, m LIMIT 1) t
UNION ALL SELECT 'monthly_worst_profit', 'Worst month by profit: ' || strftime(m, '%Y-%m') || ' — ' || {_m('p')} || '.'
  FROM (SELECT * FROM mo ORDER BY p, m LIMIT 1) t WHERE p < 0
UNION ALL SELECT 'quarterly_summary', 'Last 8 quarters: ' || string_agg(year(q) || 'Q' || quarter(q) || ': Sales='
  || {_m('s')} || ', Profit=' || {_m('p')}, '; ' ORDER BY q) || '.' FROM qu HAVING COUNT(*) > 0
UNION ALL SELECT 'dim_' || dim, 'Dimension ''' || dim || ''' values: [' || string_agg('''' || v || '''', ', ' ORDER BY v)
  || ']. Detail: ' || string_agg(v || ': Sales=' || {_m('s')} || ', Profit=' || {_m('p')}, '; ' ORDER BY s DESC, v) || '.'
  FROM dims WHERE dim IN ('region', 'segment', 'category') GROUP BY dim
UNION ALL SELECT 'top' || k || '_' || r.dim || '_profit', 'Top ' || k || ' ' || replace(r.dim, '_', ' ') || ' by profit: '
  || string_agg(v || ' (' || {_m('p')} || ')', ', ' ORDER BY rp) || '.'
  FROM ranked r JOIN topk USING (dim) WHERE rp <= k GROUP BY r.dim, k
UNION ALL SELECT 'top' || k || '_' || r.dim || '_sales', 'Top ' || k || ' ' || replace(r.dim, '_', ' ') || ' by sales: '
  || string_agg(v || ' (' || {_m('s')} || ')', ', ' ORDER BY rs) || '.'
  FROM ranked r JOIN topk USING (dim) WHERE rs <= k GROUP BY r.dim, k
UNION ALL SELECT 'discount_impact', 'Discount impact on profit: ' || string_agg('Discount ' || bucket || ': avg profit='
  || {_m('ap')} || ', avg sales=' || {_m('av')} || ' (' || n || ' orders)', '; '
  ORDER BY CASE bucket WHEN '0-10%' THEN 0 WHEN '10-20%' THEN 1 WHEN '20-30%' THEN 2 ELSE 3 END) || '.'
  FROM disc HAVING COUNT(*) > 0
UNION ALL SELECT 'segment_category_cross', 'Top 9 Segment×Category combos by profit: '
  || string_agg(segment || '/' || category || ': Profit=' || {_m('p')}, '; ' ORDER BY p DESC, segment, category) || '.'
  FROM sc HAVING COUNT(*) > 0
"""
ORACLE_SQL["facts"] = ORDER_LINES_CTE + ", " + _FACTS_SQL.strip()[5:]


@register("detail_loss_totals", """
SELECT COUNT(*) AS groups, CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders,
       CAST(COALESCE(SUM(CAST(profit AS DECIMAL(38,2))), 0) AS DOUBLE) AS total_loss,
       CAST(COALESCE(SUM(CAST(sales AS DECIMAL(38,2))), 0) AS DOUBLE) AS total_sales
FROM (
  SELECT COUNT(DISTINCT order_id) AS orders, CAST(ROUND(SUM(sales), 2) AS DOUBLE) AS sales,
         CAST(ROUND(SUM(profit), 2) AS DOUBLE) AS profit, SUM(profit) AS p, sub_category, category
  FROM order_lines GROUP BY sub_category, category HAVING SUM(profit) < 0
  ORDER BY p ASC, sub_category, category LIMIT 15) t""")
def q_detail_loss_totals(spark, sf_dir):
    return detail.detail_totals(detail.detail_summary(_ol_by_order(spark, sf_dir), "sub_category"))


_FOLLOWUP_CTE = """fq AS (
  SELECT conv_id, last_question || ' ' || last_answer AS query FROM (
    SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question,
           arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer
    FROM conversations GROUP BY conv_id) t
  WHERE last_question IS NOT NULL AND last_answer IS NOT NULL),
"""


@register("followup_retrieval", _tfidf_sql("fq", "conv_id", "query", _FOLLOWUP_CTE) + f"""
, hits AS (SELECT qid, doc_id, score, rank AS c FROM r WHERE rank <= 12 AND score >= 0.02),
pins AS (SELECT conv_id AS qid, unnest([{', '.join(map(str, _PINS))}]) AS doc_id,
                unnest(range(0, {len(_PINS)})) AS pp FROM fq),
m AS (SELECT COALESCE(h.qid, p.qid) AS qid, COALESCE(h.doc_id, p.doc_id) AS doc_id, h.score, h.c, p.pp
      FROM hits h FULL OUTER JOIN pins p ON h.qid = p.qid AND h.doc_id = p.doc_id)
SELECT qid, doc_id, COALESCE(score, 0.0) AS score, pp IS NOT NULL AS pinned,
       ROW_NUMBER() OVER (PARTITION BY qid ORDER BY CASE WHEN pp IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL AND c IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL THEN c END NULLS FIRST,
                          CASE WHEN pp IS NOT NULL THEN pp END NULLS FIRST,
                          score DESC NULLS LAST, c ASC NULLS LAST) AS position
FROM m""", with_view=False)
def q_followup_retrieval(spark, sf_dir):
    """R8 -> R3-R5: each conversation's last question + last answer retrieved
    with k = 8 and the follow-up floor 0.02 (the suggestion path)."""
    idx = retrieval.fit_tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    fq = history.followup_query(read_table(spark, sf_dir, "conversations"))
    return retrieval.retrieve_pinned(idx, fq, k=8, min_score=0.02, pinned_ids=_PINS,
                                     qid_col="conv_id", text_col="query")


# ── U2, R5, R6: duplicate ids, a pin that is not indexed, a prompt with the chat's summary ──

_DOUBLED_CTE = """doubled AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, 'zz ' || text FROM documents),
once AS (SELECT doc_id, min(text) AS text FROM doubled GROUP BY doc_id),
"""
_PINS_ABSENT = (1, -5, 3)


@register("tfidf_duplicates_pins", _tfidf_sql("benchmark", "item_id", "text", _DOUBLED_CTE, "once") + f"""
, hits AS (SELECT qid, doc_id, score, rank AS c FROM r WHERE rank <= 10 AND score >= 0.03),
pins AS (SELECT * FROM (SELECT item_id AS qid, unnest([{', '.join(map(str, _PINS_ABSENT))}]) AS doc_id,
                unnest(range(0, {len(_PINS_ABSENT)})) AS pp FROM benchmark) t WHERE doc_id IN (SELECT doc_id FROM once)),
m AS (SELECT COALESCE(h.qid, p.qid) AS qid, COALESCE(h.doc_id, p.doc_id) AS doc_id, h.score, h.c, p.pp
      FROM hits h FULL OUTER JOIN pins p ON h.qid = p.qid AND h.doc_id = p.doc_id)
SELECT qid, doc_id, COALESCE(score, 0.0) AS score, pp IS NOT NULL AS pinned,
       ROW_NUMBER() OVER (PARTITION BY qid ORDER BY CASE WHEN pp IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL AND c IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL THEN c END NULLS FIRST,
                          CASE WHEN pp IS NOT NULL THEN pp END NULLS FIRST,
                          score DESC NULLS LAST, c ASC NULLS LAST) AS position
FROM m""", with_view=False)
def q_tfidf_duplicates_pins(spark, sf_dir):
    """Every document twice under its id (de-duplicated before fitting); one pinned id is in no document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.select("doc_id", F.concat(F.lit("zz "), "text").alias("text")))
    return retrieval.retrieve_pinned(retrieval.fit_tfidf(twice, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"), k=6,
                                     min_score=0.03, pinned_ids=_PINS_ABSENT, qid_col="item_id", text_col="text")


@register("chat_context", _tfidf_sql("fq", "conv_id", "query", _FOLLOWUP_CTE) + """
, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rr FROM conversations),
h AS (SELECT conv_id, COALESCE(string_agg(CASE WHEN rr <= 10 THEN
           CASE WHEN role = 'user' THEN 'User' ELSE 'Bot' END || ': ' ||
           CASE WHEN length(COALESCE(text, '')) > 200 THEN substring(COALESCE(text, ''), 1, 200) || '...'
                ELSE COALESCE(text, '') END END, chr(10) ORDER BY turn), '') AS summary
      FROM k WHERE rr <= 16 GROUP BY conv_id),
t AS (SELECT r.qid, string_agg('  - ' || d.text, chr(10) ORDER BY r.rank) AS facts
      FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 6 GROUP BY r.qid)
SELECT COALESCE(t.qid, h.conv_id) AS qid, concat_ws(chr(10),
       CASE WHEN COALESCE(h.summary, '') <> '' THEN '[Recent conversation]' || chr(10) || h.summary END,
       CASE WHEN t.facts IS NOT NULL THEN chr(10) || '[Verified data facts from dashboard]' || chr(10) || t.facts END) AS context
FROM t FULL OUTER JOIN h ON t.qid = h.conv_id""", with_view=False)
def q_chat_context(spark, sf_dir):
    """R6 with both parts: every conversation's summary and the facts its last exchange retrieves."""
    docs, conv = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "conversations")
    ranked = retrieval.retrieve(retrieval.fit_tfidf(docs, "doc_id", "text"), history.followup_query(conv), 6, "conv_id", "query")
    summaries = history.history_summary(conv).select(F.col("conv_id").alias("qid"), "summary")
    return retrieval.context_block(ranked.withColumnRenamed("rank", "position"), docs, "doc_id", "text", summaries)


# ── the answer path: facts -> TF-IDF -> k = 7 with the pinned schema / KPI facts ──

# fixed values: facts the engine always returns first
_FACT_PINS = ("schema_metrics", "schema_dimensions", "kpi_summary")

_FACT_QUERY_CTE = f"""facts AS ({_FACTS_SQL.strip()}),
uq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, text
       FROM conversations WHERE role = 'user'),
"""


@register("fact_retrieval", _tfidf_sql("uq", "qid", "text", _FACT_QUERY_CTE, "facts", "chunk_id", "text") + f"""
, hits AS (SELECT qid, doc_id, score, rank AS c FROM r WHERE rank <= 11 AND score >= 0.03),
pins AS (SELECT qid, unnest([{', '.join(_q(x) for x in _FACT_PINS)}]) AS doc_id,
                unnest(range(0, {len(_FACT_PINS)})) AS pp FROM uq),
m AS (SELECT COALESCE(h.qid, p.qid) AS qid, COALESCE(h.doc_id, p.doc_id) AS doc_id, h.score, h.c, p.pp
      FROM hits h FULL OUTER JOIN pins p ON h.qid = p.qid AND h.doc_id = p.doc_id)
SELECT qid, doc_id, COALESCE(score, 0.0) AS score, pp IS NOT NULL AS pinned,
       ROW_NUMBER() OVER (PARTITION BY qid ORDER BY CASE WHEN pp IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL AND c IS NOT NULL THEN 0 ELSE 1 END,
                          CASE WHEN pp IS NOT NULL THEN c END NULLS FIRST,
                          CASE WHEN pp IS NOT NULL THEN pp END NULLS FIRST,
                          score DESC NULLS LAST, c ASC NULLS LAST) AS position
FROM m""")
def q_fact_retrieval(spark, sf_dir):
    """Every user question of ``conversations`` against the fact rows built
    from the order lines: top 7 + 4 candidates, floor 0.03, schema and KPI
    facts pinned first (the engine's answer path, R1-R5 over K1-K13)."""
    f = facts.build_facts(_ol(spark, sf_dir)).select("chunk_id", "text")
    idx = retrieval.fit_tfidf(f, "chunk_id", "text")
    qs = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    return retrieval.retrieve_pinned(idx, qs, k=7, min_score=0.03, pinned_ids=_FACT_PINS)


# ── rows for what only unit tests exercised: wide load, semi-top, labels, percent discounts, other relative units ──

@register("wide_load", f"""
SELECT region AS breakdown, {sql_metrics(['sales', 'profit', 'orders'])}, MIN(order_date) AS first_date, MAX(ship_date) AS last_shipped
FROM order_lines WHERE order_date BETWEEN DATE '1996-02-01' AND DATE '1999-06-30' AND segment IN ('AUTOMOBILE', 'BUILDING')
GROUP BY region""")
def q_wide_load(spark, sf_dir):
    """The lines written as a wide text table (dates as text, decimal commas, percent signs), loaded with
    filters: dates and money are coerced to their types before the sums."""
    from kpiforge.sources.order_lines import load_orders
    from kpiforge.sources.tables import shared_path

    ol = _ol(spark, sf_dir)
    comma = [F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in ("sales", "profit")]
    text = ol.select("order_id", F.col("order_date").cast("string").alias("order_date"), F.col("ship_date").cast("string").alias("ship_date"),
                     "region", "state", "segment", "category", "sub_category", "product_name", *comma,
                     F.concat((F.col("discount") * 100).cast("string"), F.lit("%")).alias("discount"))
    path = shared_path(spark, "wide-text")
    text.write.csv(path, header=True)
    rows = load_orders(spark, path, {"date_range": ("1996-02-01", "1999-06-30"), "segment": ["AUTOMOBILE", "BUILDING"]},
                       fmt="csv", options={"header": "true"})
    return rows.groupBy(F.col("region").alias("breakdown")).agg(
        *kpi.metric_cols(["sales", "profit", "orders"]), F.min("order_date").alias("first_date"), F.max("ship_date").alias("last_shipped"))


@register("trend_of_top3", f"""
WITH t AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, sub_category AS breakdown, {sql_metrics(['profit'])}
           FROM order_lines GROUP BY 1, 2),
top AS (SELECT sub_category FROM order_lines GROUP BY sub_category ORDER BY SUM(profit) DESC, sub_category LIMIT 3)
SELECT * FROM t WHERE breakdown IN (SELECT sub_category FROM top)""")
def q_trend_of_top3(spark, sf_dir):
    """the monthly trend of the three best sub-categories."""
    from kpiforge.operators.filters import semi_top
    ol = _ol(spark, sf_dir)
    return semi_top(kpi.kpi_trend(ol, ["profit"], "month", breakdown_by="sub_category"), kpi.kpi_rank(ol, ["profit"], "sub_category", 3))


@register("period_labels", """
SELECT 'year' AS grain, strftime(date_trunc('year', order_date), '%Y') AS label, strftime(MIN(order_date), '%b %Y') AS context,
       COUNT(*) AS lines FROM order_lines GROUP BY 2
UNION ALL SELECT 'quarter', year(order_date) || ' Q' || quarter(order_date), strftime(MIN(order_date), '%b %Y'), COUNT(*) FROM order_lines GROUP BY 2
UNION ALL SELECT 'month', strftime(order_date, '%Y-%m'), strftime(MIN(order_date), '%b %Y'), COUNT(*) FROM order_lines GROUP BY 2
UNION ALL SELECT 'week', strftime(date_trunc('week', order_date), '%Y-%m-%d'), strftime(MIN(order_date), '%b %Y'), COUNT(*)
FROM order_lines GROUP BY 2""")
def q_period_labels(spark, sf_dir):
    """D-c: the label of every period of every grain, and the context label of its first line, in one pass."""
    from kpiforge.functions.dates import GRAINS, context_label, period_label, period_start

    grains = [g for g in GRAINS]
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), period_label(period_start(F.col("order_date"), g), g).alias("label")) for g in grains]))
    rows = _ol(spark, sf_dir).select("order_date", cells.alias("c")).select("order_date", "c.grain", "c.label")
    return rows.groupBy("grain", "label").agg(context_label(F.min("order_date")).alias("context"), F.count(F.lit(1)).alias("lines"))


def _percent(ol):
    return ol.withColumn("discount", (F.col("discount") * 100).cast("decimal(8,2)"))


@register("discount_buckets_percent", ORACLE_SQL["discount_buckets"], with_view=False)
def q_discount_buckets_percent(spark, sf_dir):
    """M-c: discounts stored as percentages fall into the same buckets."""
    return dashboard.discount_impact(_percent(_ol(spark, sf_dir)))


@register("normalized_discount", """
SELECT segment, MAX(discount) AS largest, CAST(SUM(discount) AS DOUBLE) AS total FROM order_lines GROUP BY segment""")
def q_normalized_discount(spark, sf_dir):
    """M-c: percentages divided by 100 because the column's maximum is above 1."""
    from kpiforge.functions.numeric import normalize_discount

    ol = _percent(_ol(spark, sf_dir))
    d = normalize_discount(ol).cast("decimal(6,2)")
    return ol.withColumn("d", d).groupBy("segment").agg(F.max("d").alias("largest"), F.sum("d").cast("double").alias("total"))


_RELATIVE = {"relative_6w": (6, "week", "42 DAY"), "relative_5m": (5, "month", "5 MONTH"), "relative_2y": (2, "year", "24 MONTH")}


def _make_relative(n, unit):
    def q(spark, sf_dir):
        df = _ol(spark, sf_dir)
        return kpi.kpi_value(df, ["sales", "profit"], *relative_window(df, n, unit, latest=latest_order_date(spark, sf_dir)),
                             breakdown_by="region")
    return q


for _name, (_n, _unit, _interval) in _RELATIVE.items():
    register(_name, f"""
SELECT region AS breakdown, {sql_metrics(['sales', 'profit'])} FROM order_lines
WHERE order_date BETWEEN CAST({_ANCHOR} - INTERVAL {_interval} AS DATE) AND {_ANCHOR} GROUP BY region""")(_make_relative(_n, _unit))


@register("current_periods", f"""
SELECT g AS grain, {sql_metrics(['sales', 'orders'])} FROM order_lines, (VALUES ('week'), ('month'), ('year')) t(g)
WHERE order_date BETWEEN CASE g WHEN 'week' THEN CAST(date_trunc('week', {_ANCHOR}) AS DATE)
      WHEN 'month' THEN CAST(date_trunc('month', {_ANCHOR}) AS DATE) ELSE CAST(date_trunc('year', {_ANCHOR}) AS DATE) END AND {_ANCHOR}
GROUP BY g""")
def q_current_periods(spark, sf_dir):
    """F8: this week, month and year up to the latest date: one scan, a line counts for each window it lies in."""
    from kpiforge.functions.metrics import metric_cols
    from kpiforge.operators.filters import current_window

    df, last = _ol(spark, sf_dir), latest_order_date(spark, sf_dir)
    inside = {g: F.col("order_date").between(*current_window(df, g, latest=last)) for g in ("week", "month", "year")}
    rows = df.where(inside["week"] | inside["month"] | inside["year"]).withColumn(
        "grain", F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(g)) for g, holds in inside.items()]))))
    return rows.groupBy("grain").agg(*metric_cols(["sales", "orders"]))


@register("detail_profit_positive", """
SELECT order_id, order_date, segment AS breakdown, category, product_name, sales, profit, discount
FROM order_lines WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND profit > 0
ORDER BY profit, order_id, order_date, breakdown, category, product_name, sales, discount LIMIT 10""")
def q_detail_profit_positive(spark, sf_dir):
    return detail.detail_rows(_ol(spark, sf_dir), "segment", "1997-01-01", "1997-12-31", cond="profit_positive")


@register("detail_loss_totals_all", """
SELECT COUNT(*) AS groups, CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders,
       CAST(COALESCE(SUM(CAST(profit AS DECIMAL(38,2))), 0) AS DOUBLE) AS total_loss,
       CAST(COALESCE(SUM(CAST(sales AS DECIMAL(38,2))), 0) AS DOUBLE) AS total_sales
FROM (SELECT COUNT(DISTINCT order_id) AS orders, CAST(ROUND(SUM(sales), 2) AS DOUBLE) AS sales,
             CAST(ROUND(SUM(profit), 2) AS DOUBLE) AS profit
      FROM order_lines GROUP BY sub_category, category HAVING SUM(profit) < 0) t""")
def q_detail_loss_totals_all(spark, sf_dir):
    """A19 over every loss group, not only the shown ones."""
    return detail.detail_totals(detail.detail_summary(_ol_by_order(spark, sf_dir), "sub_category", top_k=None))


# ── a table of plans answered at once: windows made from the months of `orders` ──

from kpiforge.operators import plan_batch  # noqa: E402

_MONTHS_SQL = "SELECT DISTINCT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS m FROM orders"


def batch_of_plans(spark, sf_dir) -> DataFrame:
    """Five plans for each month with orders: a value, a comparison by region and one of half months, a ranking and a trend."""
    m = read_table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).distinct()
    none, end = F.lit(None).cast("string"), F.last_day("m")

    def plan(kind, intent, metric, by, start, last, compare=none, grain=none, k=None):
        return F.struct(F.concat(F.lit(kind + "-"), F.date_format("m", "yyyyMM")).alias("plan_id"), F.lit(intent).alias("intent"),
                        F.lit(metric).alias("metric"), F.lit(by).cast("string").alias("breakdown_by"), start.alias("start_date"),
                        last.alias("end_date"), compare.alias("compare_period"), grain.alias("time_grain"), F.lit(k).cast("int").alias("top_k"))

    start, quarter = F.col("m"), F.add_months("m", -2)
    return m.select(F.inline(F.array(
        plan("v", "kpi_value", "orders", "segment", start, end),
        plan("c", "kpi_compare", "profit", "region", start, end, F.lit("yoy")),
        plan("r", "kpi_rank", "sales", "sub_category", quarter, end, k=5),
        plan("t", "kpi_trend", "profit_margin", None, quarter, end, grain=F.lit("month")),
        plan("h", "kpi_compare", "sales", None, start, F.date_add("m", 14), F.lit("prev_period")))))


@register("plan_batch", f"""
WITH months AS ({_MONTHS_SQL}),
p AS (SELECT strftime(m, '%Y%m') AS ym, m, last_day(m) AS e, CAST(m - INTERVAL 2 MONTH AS DATE) AS q FROM months),
w AS (SELECT 'v-' || ym AS plan_id, 'kpi_value' AS intent, 'orders' AS metric, 'segment' AS dim, 0 AS side, m AS f, e AS l, CAST(NULL AS DATE) AS period, CAST(NULL AS INT) AS k FROM p
  UNION ALL SELECT 'c-' || ym, 'kpi_compare', 'profit', 'region', 0, m, e, NULL, NULL FROM p
  UNION ALL SELECT 'c-' || ym, 'kpi_compare', 'profit', 'region', 1, CAST(m - INTERVAL 12 MONTH AS DATE), CAST(e - INTERVAL 12 MONTH AS DATE), NULL, NULL FROM p
  UNION ALL SELECT 'r-' || ym, 'kpi_rank', 'sales', 'sub_category', 0, q, e, NULL, 5 FROM p
  UNION ALL SELECT 't-' || ym, 'kpi_trend', 'profit_margin', 'none', 0, s, last_day(s), s, NULL FROM (SELECT ym, CAST(unnest([q, q + INTERVAL 1 MONTH, m]) AS DATE) AS s FROM p)
  UNION ALL SELECT 'h-' || ym, 'kpi_compare', 'sales', 'none', 0, m, m + 14, NULL, NULL FROM p
  UNION ALL SELECT 'h-' || ym, 'kpi_compare', 'sales', 'none', 1, m - 15, m - 1, NULL, NULL FROM p),
g AS (SELECT plan_id, side, period, CASE dim WHEN 'segment' THEN segment WHEN 'region' THEN region WHEN 'sub_category' THEN sub_category END AS value,
    COUNT(*) AS n, CASE any_value(metric) WHEN 'sales' THEN CAST(SUM(sales) AS DOUBLE) WHEN 'profit' THEN CAST(SUM(profit) AS DOUBLE)
      WHEN 'orders' THEN CAST(COUNT(DISTINCT order_id) AS DOUBLE) ELSE {SQL_METRIC['profit_margin']} END AS x
  FROM w JOIN order_lines ON order_date BETWEEN f AND l GROUP BY ALL),
a AS (SELECT DISTINCT plan_id, intent, metric, dim, k FROM w),
z AS (SELECT a.plan_id, a.intent, a.metric, a.k, g.period, g.value AS breakdown,
    CASE WHEN intent = 'kpi_compare' THEN COALESCE(MAX(x) FILTER (side = 0), 0.0) ELSE MAX(x) FILTER (side = 0) END AS current,
    CASE WHEN intent = 'kpi_compare' THEN COALESCE(MAX(x) FILTER (side = 1), 0.0) END AS previous,
    COALESCE(MAX(n) FILTER (side = 0), 0) > 0 AS seen, a.dim
  FROM a LEFT JOIN g USING (plan_id) GROUP BY a.plan_id, a.intent, a.metric, a.k, a.dim, g.period, g.value),
c AS (SELECT *, CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100 END AS change_pct FROM z
  WHERE seen OR (dim = 'none' AND intent <> 'kpi_trend')),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY period NULLS FIRST, CASE WHEN intent = 'kpi_compare' THEN change_pct END NULLS LAST,
    CASE WHEN intent IN ('kpi_value', 'kpi_rank') THEN current END DESC NULLS LAST, breakdown NULLS LAST) AS position FROM c)
SELECT plan_id, intent, metric, period, breakdown, current, previous, change_pct, position FROM r WHERE k IS NULL OR position <= k""")
def q_plan_batch(spark, sf_dir):
    """All plans of all months from one pass over the lines."""
    tasks = line_tasks(spark, sf_dir)
    return plan_batch.answer_plans(order_lines_by_order(spark, sf_dir, tasks), batch_of_plans(spark, sf_dir), tasks)


# ── S7: stored sums and order sets, kept current by three deliveries ─────

from kpiforge.operators.kpi_store import KpiStore  # noqa: E402
from kpiforge.sources.tables import shared_path, shared_table  # noqa: E402

_STORE_SETS = "\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, {v} AS value, period, {sql_metrics(['sales', 'profit', 'orders', 'profit_margin'])} FROM q GROUP BY 2, 3"
    for d, v in [("total", "CAST(NULL AS VARCHAR)"), *[(d, d) for d in ("region", "segment", "category", "sub_category", "state")]])


@register("stored_breakdown", "WITH q AS (SELECT *, CAST(date_trunc('quarter', order_date) AS DATE) AS period FROM order_lines)\n" + _STORE_SETS)
def q_stored_breakdown(spark, sf_dir):
    """S7, A20 by quarter from a store that took in lines shipped before 1996 (those of the first of a month twice, by mistake),
    then the lines shipped later, late ones of orders it knew among them, then the first of each month again, whole."""
    # the deliveries are parts of the joined lines: joined once, written, read by each
    lines = shared_table(_ol(spark, sf_dir).drop("product_name", "discount"), "store-lines")
    early, first = F.coalesce(F.col("ship_date") < "1996-01-01", F.lit(False)), F.dayofmonth("order_date") == 1
    store = KpiStore(spark, shared_path(spark, "kpi-store"))
    store.deliver(lines.where(early).unionByName(lines.where(early & first)))
    store.deliver(lines.where(~early))
    store.deliver(lines.where(first), read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("order_date")).where(first))
    return store.breakdown("quarter")


# ── R2, R3 by score bounds; R1, U2 from an index that took three updates ──

from kpiforge.operators import retrieval_bounds  # noqa: E402
from kpiforge.operators.retrieval_store import TfidfStore  # noqa: E402


@register("tfidf_topk_bounded", _TFIDF_SQL + """
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10""", with_view=False)
def q_tfidf_topk_bounded(spark, sf_dir):
    """The top 10 of every benchmark item; blocks of documents that cannot reach them are not read."""
    idx = retrieval_bounds.bounded_index(retrieval.fit_tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return retrieval_bounds.retrieve_bounded(idx, read_table(spark, sf_dir, "benchmark"), 10, "item_id", "text")


@register("tfidf_updated", _TFIDF_SQL + """
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10""", with_view=False)
def q_tfidf_updated(spark, sf_dir):
    """An index of English drafts and benchmark items; then all documents come (the drafts' last versions replace them), then the
    benchmark items go."""
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "benchmark")
    drafts = docs.where("lang = 'en'").select("doc_id", F.concat(F.lit("draft "), F.coalesce("text", F.lit(""))).alias("text"))
    foreign = items.select((-1 - F.col("item_id")).alias("doc_id"), "text")
    store = TfidfStore(spark, shared_path(spark, "tfidf-store"))
    store.update(drafts.unionByName(foreign), id_col="doc_id")
    store.update(docs, id_col="doc_id")
    store.update(delete=foreign, id_col="doc_id")
    return retrieval.retrieve(store.index(), items, 10, "item_id", "text")


# ── S4: plans as SQL table functions; S1, S3: stored layouts; R7: live windows ──

from kpiforge.sources import layout, sql_functions  # noqa: E402
from kpiforge.streaming import live_window  # noqa: E402


@register("sql_rank", f"""
SELECT breakdown, value, CAST(ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, breakdown) AS INT) AS position FROM (
  SELECT sub_category AS breakdown, {SQL_METRIC['profit_margin']} AS value FROM order_lines
  WHERE order_date >= DATE '1996-01-01' GROUP BY sub_category) t QUALIFY position <= 7""")
def q_sql_rank(spark, sf_dir):
    sql_functions.register_sql(spark, _ol(spark, sf_dir))
    return spark.sql("SELECT * FROM kpi_rank('sub_category', 'profit_margin', 7, first => DATE'1996-01-01')")


@register("sql_compare", f"""
WITH a AS (SELECT state AS breakdown,
  CAST(COUNT(DISTINCT CASE WHEN order_date BETWEEN DATE '1999-04-01' AND DATE '1999-06-30' THEN order_id END) AS DOUBLE) AS current,
  CAST(COUNT(DISTINCT CASE WHEN order_date BETWEEN DATE '1998-12-31' AND DATE '1999-03-31' THEN order_id END) AS DOUBLE) AS previous,
  COUNT(CASE WHEN order_date BETWEEN DATE '1999-04-01' AND DATE '1999-06-30' THEN 1 END) AS n FROM order_lines GROUP BY state)
SELECT c.breakdown, c.current, c.previous, CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100 END AS change_pct, v.orders AS all_orders
FROM a c JOIN (SELECT state AS breakdown, COUNT(DISTINCT order_id) AS orders FROM order_lines GROUP BY state) v USING (breakdown) WHERE n > 0""")
def q_sql_compare(spark, sf_dir):
    """Two functions joined in one statement."""
    sql_functions.register_sql(spark, _ol(spark, sf_dir))
    return spark.sql("""SELECT c.*, v.orders AS all_orders FROM kpi_compare('orders', 'state', DATE'1999-04-01', DATE'1999-06-30', 'prev_period') c
        JOIN kpi_by('state') v ON v.breakdown = c.breakdown""")


@register("by_region_co_located", f"SELECT region AS breakdown, {sql_metrics(['profit', 'orders'])} FROM order_lines GROUP BY region")
def q_by_region_co_located(spark, sf_dir):
    """S3 from tables bucketed by order: the lines are not moved to meet their orders."""
    name = "star_" + shared_path(spark, "x").rsplit("-", 1)[1]
    layout.store_by_order(spark, sf_dir, shared_path(spark, "star"), name)
    return kpi.kpi_value(layout.lines_by_order(spark, sf_dir, name), ["profit", "orders"], breakdown_by="region")


@register("clustered_filter", f"""
SELECT category AS breakdown, {sql_metrics(['sales', 'orders'])} FROM order_lines
WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND region IN ('ASIA', 'EUROPE') GROUP BY category""")
def q_clustered_filter(spark, sf_dir):
    """F1, F2 over the wide table stored along the Z-curve of date, region and category."""
    path = shared_path(spark, "clustered")
    layout.store_clustered(_ol(spark, sf_dir), path)
    return kpi.kpi_value(spark.read.parquet(path), ["sales", "orders"], "1997-01-01", "1997-06-30", breakdown_by="category",
                         filters={"region": ["ASIA", "EUROPE"]})


@register("live_history_window", ORACLE_SQL["history_window"], with_view=False)
def q_live_history_window(spark, sf_dir):
    """R7 from a stream of `conversations` in batches that hold each conversation's turns out of order."""
    conv, inbox, out = read_table(spark, sf_dir, "conversations"), shared_path(spark, "messages"), shared_path(spark, "windows")
    conv.repartition(3, "turn").write.parquet(inbox)  # whole turns a file: late ones come in later batches
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    live_window.start_windows(stream, out, shared_path(spark, "windows-state")).awaitTermination()
    return live_window.current_windows(spark, out)


# ── S7: the dashboard's path, plans as users write them, and KPIs refreshed from a stream ──

from kpiforge.plans import plan as plans  # noqa: E402
from kpiforge.sources.order_lines import materialize_order_lines  # noqa: E402
from kpiforge.streaming import refresh  # noqa: E402

# frame -> its query alone, its keys and its values
_FRAMES = {
    "sales_profit_by_month": ("chart_sales_profit_by_month", ("order_date",), ("sales", "profit")),
    "orders_by_month": ("orders_by_month", ("order_date",), ("orders",)),
    "profit_by_region": ("chart_profit_by_region", ("region",), ("profit",)),
    "profit_by_segment": ("chart_profit_by_segment", ("segment",), ("profit",)),
    "profit_heatmap": ("heatmap_cells", ("segment", "region"), ("profit",)),
    "discount_impact": ("discount_buckets", ("discount_bucket",), ("avg_sales", "avg_profit")),
    "top_sub_categories": ("top_subcategories", ("sub_category",), ("profit",)),
    "category_share": ("category_share", ("category",), ("profit", "share_pct")),
}


def _long(frame, keys, values, text: str, null: str) -> list[str]:
    """The columns of a chart frame under the names that all of them share."""
    k = [f"CAST({c} AS {text}) AS k{i + 1}" for i, c in enumerate(keys)] + [f"CAST({null} AS {text}) AS k2"] * (len(keys) == 1)
    v = [f"CAST({c} AS DOUBLE) AS v{i + 1}" for i, c in enumerate(values)] + [f"CAST({null} AS DOUBLE) AS v2"] * (len(values) == 1)
    return [f"'{frame}' AS frame", *k, *v]


@register("dashboard_from_wide", "\nUNION ALL ".join(
    f"SELECT {', '.join(_long(name, keys, values, 'VARCHAR', 'NULL'))} FROM ({ORACLE_SQL[own]}) t"
    for name, (own, keys, values) in _FRAMES.items()), with_view=False)
def q_dashboard_from_wide(spark, sf_dir):
    """The wide table is written once, by year; all eight frames come from two passes over it."""
    path, out = shared_path(spark, "wide"), None
    materialize_order_lines(_ol(spark, sf_dir), path)
    frames = dashboard.dashboard_frames(spark.read.parquet(path))
    for name, (_, keys, values) in _FRAMES.items():
        one = frames[name].selectExpr(*_long(name, keys, values, "STRING", "NULL"))
        out = one if out is None else out.unionByName(one)
    out = shared_table(out, "frames")
    frames["shared"].unpersist()
    return out


# fixed values: plans as a question interface hands them over; some break a rule
RAW_PLANS = (
    {"intent": "kpi_value", "metrics": ["sales", "orders"]},
    {"intent": "kpi_value", "metrics": "profit", "breakdown_by": "segment", "filters": {"region": ["ASIA", "AFRICA"]}},
    {"intent": "kpi_value", "metrics": ["sales"], "time_grain": "year"},  # becomes a trend
    {"intent": "kpi_trend", "metrics": ["profit", "profit_margin"], "time_grain": "quarter", "breakdown_by": "region", "start_date": "1997-01-01", "end_date": "1998-12-31"},
    {"intent": "kpi_rank", "metrics": ["profit_margin", "sales"], "breakdown_by": "state", "top_k": 6, "order_by": "sales"},
    {"intent": "kpi_compare", "metrics": ["sales"], "compare_period": "yoy", "breakdown_by": "segment", "start_date": "1999-01-01", "end_date": "1999-06-30"},
    {"intent": "kpi_rank", "metrics": ["sales"], "breakdown_by": "state", "top_k": 51},
    {"intent": "kpi_rank", "metrics": ["sales"], "top_k": 5},
    {"intent": "kpi_trend", "metrics": ["sales"]},
    {"intent": "kpi_value", "metrics": ["sales", "profit", "orders"]},
    {"intent": "kpi_compare", "metrics": ["sales", "profit"], "compare_period": "mom", "start_date": "1999-01-01", "end_date": "1999-06-30"},
    {"intent": "kpi_compare", "metrics": ["sales"], "compare_period": "yoy"},
    {"intent": "kpi_value", "metrics": ["sales"], "start_date": "1999-02-01", "end_date": "1999-01-01"},
    {"intent": "kpi_value", "metrics": ["sales"], "filters": {"region": "ASIA"}},
    {"intent": "clarify"}, {"intent": "guess"},
)
_ASKED = "order_date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'"
_D = SQL_METRIC


@register("validated_plans", f"""
SELECT 0 AS plan, CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS DATE) AS period, CAST(NULL AS VARCHAR) AS breakdown, {_D['sales']} AS v1,
  CAST({_D['orders']} AS DOUBLE) AS v2 FROM order_lines WHERE {_ASKED}
UNION ALL SELECT 1, NULL, NULL, segment, {_D['profit']}, NULL FROM order_lines WHERE {_ASKED} AND region IN ('ASIA', 'AFRICA') GROUP BY segment
UNION ALL SELECT 2, NULL, CAST(date_trunc('year', order_date) AS DATE) AS y, NULL, {_D['sales']}, NULL FROM order_lines WHERE {_ASKED} GROUP BY y
UNION ALL SELECT 3, NULL, CAST(date_trunc('quarter', order_date) AS DATE) AS q, region, {_D['profit']}, {_D['profit_margin']} FROM order_lines
  WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY q, region
UNION ALL SELECT * FROM (SELECT 4, NULL, NULL, state, {_D['profit_margin']}, {_D['sales']} AS s FROM order_lines WHERE {_ASKED} GROUP BY state
  ORDER BY s DESC, state LIMIT 6) t
UNION ALL SELECT 5, NULL, NULL, segment, c, p FROM (SELECT segment,
  COALESCE(CAST(SUM(CASE WHEN order_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN sales END) AS DOUBLE), 0.0) AS c,
  COALESCE(CAST(SUM(CASE WHEN order_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' THEN sales END) AS DOUBLE), 0.0) AS p,
  COUNT(CASE WHEN order_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN 1 END) AS n FROM order_lines GROUP BY segment) t WHERE n > 0
UNION ALL SELECT k, problem, NULL, NULL, NULL, NULL FROM (VALUES (6, 'top_k'), (7, 'breakdown_by'), (8, 'time_grain'), (9, 'metrics'), (10, 'metrics'),
  (12, 'end_date'), (13, 'filters'), (14, 'clarifying_question'), (15, 'intent')) t(k, problem)
UNION ALL SELECT 11, NULL, NULL, NULL, COALESCE(CAST(SUM(CASE WHEN {_ASKED} THEN sales END) AS DOUBLE), 0.0),
  COALESCE(CAST(SUM(CASE WHEN order_date BETWEEN DATE '1994-01-01' AND DATE '1999-12-31' THEN sales END) AS DOUBLE), 0.0) FROM order_lines""")
def q_validated_plans(spark, sf_dir):
    """Plan validation and dispatch: each raw plan's rows, or the field that broke a rule."""
    lines, out = _ol(spark, sf_dir), None
    for k, raw in enumerate(RAW_PLANS):
        try:
            plan = plans.validate_plan(raw, ("1995-01-01", "2000-12-31"))
        except plans.PlanError as problem:
            one = spark.range(1).select(F.lit(k).alias("plan"), F.lit(problem.part).alias("problem"))
        else:
            rows = plans.run_plan(lines, plan)
            values = ("current", "previous") if plan.intent == "kpi_compare" else plan.metrics
            keys = [F.col(c).cast(t) for c, t in (("period", "date"), ("breakdown", "string")) if c in rows.columns]
            one = rows.select(F.lit(k).alias("plan"), *keys, *[F.col(c).cast("double").alias(f"v{i + 1}") for i, c in enumerate(values)])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("plan", F.col("problem").cast("string"), F.col("period").cast("date"), F.col("breakdown").cast("string"),
                      F.col("v1").cast("double"), F.col("v2").cast("double"))


@register("refreshed_by_month", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, region, CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(profit) AS DOUBLE) AS profit,
  COUNT(*) AS lines FROM order_lines GROUP BY 1, 2""")
def q_refreshed_by_month(spark, sf_dir):
    """S7 from a stream: order-line files arrive in several batches; the newest complete refresh is read."""
    inbox, out = shared_path(spark, "lines-in"), shared_path(spark, "refresh")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a task reads one, a batch a third of them
    _ol(spark, sf_dir).select("order_id", "order_date", "region", "sales", "profit").repartition(files).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(inbox)
    refresh.start_refresh(stream, out, shared_path(spark, "refresh-state")).awaitTermination()
    return refresh.latest_refresh(spark, out).select("period", "region", "sales", "profit", "lines")
