"""Many KPI plans answered at once (Q1-Q4, C1-C3) from a cube of daily running sums.

``answer_plans(lines, plans)`` gives every plan of a table the rows that
:func:`kpi_value`, :func:`kpi_rank`, :func:`kpi_trend` or
:func:`kpi_compare` gives it alone, without a pass over the lines for each.

The cube has one row for each (dimension, value, day) with sales: the running
sums of everything up to that day.  A plan's window is the difference of two
of its rows, found by an as-of lookup (the last row on or before a day): one
window function over the cube and the days that plans ask for, whose groups
hold days, not lines.  Days that several plans share are looked up once.

Distinct orders.  An order that has lines on one day only adds up over days.
For others, the cube counts (order, day) rows, and a window has counted one too
many for each pair of consecutive days of an order that it holds; pairs are
kept by (value, day, next day) with their number and taken off by a join on
the dimension and both days.  So counts are exact for any input.

Cost.  The cube takes one exchange of the lines, by order (a line is several
rows only inside its task); everything after it is as large as days x values,
or plans x values.  Lines without a date count only for value and rank
plans without a window, as in the single operators; trend plans leave them out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.dates import GRAINS, previous_window_cols
from kpiforge.functions.metrics import DIMENSIONS, METRICS, change_pct, ratio_pct
from kpiforge.sources.tables import shared_table

TOTAL = "total"
_SUMS = ("sales", "profit", "n_sales", "n_profit", "orders", "lines")
_UNDATED = "0001-01-01"  # the day of lines without a date: before every window's start

PLAN_COLUMNS = ("plan_id", "intent", "metric", "breakdown_by", "start_date", "end_date", "compare_period", "time_grain", "top_k")


@dataclass(frozen=True)
class DayCube:
    """``running``: dimension, value, day and the running sums up to it.  ``repeats``: pairs of consecutive days of an order:
    dimension, value, day, next_day, n."""

    running: DataFrame
    repeats: DataFrame


def _per_order_day(lines: DataFrame, dims, tasks: int | None = None) -> DataFrame:
    """``order_id, dimension, value, day`` with sums: lines are dealt by order once (not at all if they lie so in ``tasks`` tasks)."""
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    sets = F.array(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(None).cast("string").alias("value")), *named)
    day = F.coalesce(F.col("order_date").cast("date"), F.lit(_UNDATED).cast("date")).alias("day")
    rows = lines.select("order_id", day, "sales", "profit", *dims).repartition(*([tasks] if tasks else []), "order_id").select(
        "order_id", "day", "sales", "profit", F.inline(sets))
    return rows.groupBy("order_id", "dimension", "value", "day").agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count("sales").alias("n_sales"),
        F.count("profit").alias("n_profit"), F.count(F.lit(1)).alias("lines"))


def build_cube(lines: DataFrame, dims=DIMENSIONS, tasks: int | None = None) -> DayCube:
    """The cube of an order-line table, written to the shared folder.  ``tasks``: how many tasks the lines are dealt to by order; what
    one holds is several rows for each of its lines."""
    # days of an order with a value: the lines are not sorted or moved again, an order's rows lie together
    days = _per_order_day(lines, dims, tasks)
    after = F.lead("day").over(Window.partitionBy("order_id", "dimension", "value").orderBy("day"))
    daily = shared_table(days.withColumn("next_day", F.when(F.col("order_id").isNotNull(), after)).groupBy(
        "dimension", "value", "day", "next_day").agg(
        F.count("order_id").alias("orders"), *[F.sum(c).alias(c) for c in _SUMS if c != "orders"]), "plan-days")
    upto = Window.partitionBy("dimension", "value").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = daily.groupBy("dimension", "value", "day").agg(*[F.sum(c).alias(c) for c in _SUMS]).select(
        "dimension", "value", "day", *[F.sum(c).over(upto).alias(c) for c in _SUMS])
    repeats = daily.where("next_day IS NOT NULL").select("dimension", "value", "day", "next_day", F.col("orders").alias("n"))
    return DayCube(shared_table(running, "plan-cube"), repeats)


def _windows(plans: DataFrame) -> DataFrame:
    """One row for each plan and period: ``plan_id, dimension, period, side, first, last`` (side 0: the window, 1: the one it is
    compared with)."""
    p = plans.select("*", F.coalesce("breakdown_by", F.lit(TOTAL)).alias("dimension"))
    s, e = F.col("start_date").cast("date"), F.col("end_date").cast("date")
    shifted = [previous_window_cols(s, e, c) for c in ("prev_period", "mom", "yoy")]

    def of(k: int) -> Column:
        c = F.col("compare_period")
        return F.when(c == "prev_period", shifted[0][k]).when(c == "mom", shifted[1][k]).when(c == "yoy", shifted[2][k])

    one = F.struct(F.lit(0).alias("side"), s.alias("first"), e.alias("last"))
    two = F.struct(F.lit(1).alias("side"), of(0).alias("first"), of(1).alias("last"))
    compare = F.col("intent") == "kpi_compare"
    return p.select("plan_id", "dimension", F.inline(F.when(compare, F.array(one, two)).otherwise(F.array(one))))


def _period(first: Column, last: Column, step: Column):
    """A period's name and the part of it that lies in the window."""
    def of(start: Column) -> Column:
        end = F.date_sub((start + step).cast("date"), 1)
        return F.struct(start.alias("period"), F.greatest(start, first).alias("first"), F.least(end, last).alias("last"))
    return of


def _trend_windows(plans: DataFrame, cube: DayCube) -> DataFrame:
    """The periods of trend plans, cut to the plan's window; open ends are the table's."""
    days = cube.running.where((F.col("dimension") == TOTAL) & (F.col("day") > F.lit(_UNDATED).cast("date")))
    p = plans.where("intent = 'kpi_trend'").select("*", F.coalesce("breakdown_by", F.lit(TOTAL)).alias("dimension"),
                                                   days.agg(F.min("day")).scalar().alias("low"), days.agg(F.max("day")).scalar().alias("high"))
    first = F.coalesce(F.col("start_date").cast("date"), F.col("low"))
    last = F.coalesce(F.col("end_date").cast("date"), F.col("high"))
    # nothing lies outside the table's days
    first, last = F.greatest(first, F.col("low")), F.least(last, F.col("high"))
    periods = None
    for grain, step in (("week", "7 days"), ("month", "1 month"), ("quarter", "3 months"), ("year", "1 year")):
        step = F.expr(f"INTERVAL {step}")
        ends = F.transform(F.sequence(F.trunc(first, grain), last, step), _period(first, last, step))
        periods = F.when(F.col("time_grain") == grain, ends) if periods is None else periods.when(F.col("time_grain") == grain, ends)
    return p.where(first <= last).select("plan_id", "dimension", F.lit(0).alias("side"), F.inline(periods))


def _looked_up(cube: DayCube, windows: DataFrame) -> DataFrame:
    """Sums of each window and value: ``plan_id, period, side, value`` and the sums."""
    undated = F.lit(_UNDATED).cast("date")
    # what lies before the window is taken off: up to the day before its start; undated lines too if only its end is given
    before = F.when(F.col("first").isNotNull(), F.date_sub("first", 1)).when(F.col("last").isNotNull(), undated)
    upto = F.coalesce("last", F.lit("9999-12-31").cast("date"))
    ends = windows.select("plan_id", "dimension", "period", "side", F.inline(F.array(
        F.struct(F.lit(1).alias("sign"), upto.alias("day")), F.struct(F.lit(-1).alias("sign"), before.alias("day"))))).where("day IS NOT NULL")
    asked = ends.select("dimension", "day").distinct()
    values = cube.running.select("dimension", "value").distinct()
    state = F.struct(*_SUMS)
    rows = cube.running.select("dimension", "value", "day", F.lit(0).alias("asks"), state.alias("sums")).unionByName(
        asked.join(values, "dimension").select("dimension", "value", "day", F.lit(1).alias("asks"), F.lit(None).cast(
            cube.running.select(state.alias("s")).schema["s"].dataType).alias("sums")))
    as_of = rows.withColumn("sums", F.last("sums", ignorenulls=True).over(
        Window.partitionBy("dimension", "value").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0))).where(
        "asks = 1 AND sums IS NOT NULL").select("dimension", "value", "day", "sums")
    return ends.join(as_of, ["dimension", "day"]).groupBy("plan_id", "period", "side", "value").agg(
        *[F.sum(F.col("sign") * F.col(f"sums.{c}")).alias(c) for c in _SUMS])


def _counted_again(cube: DayCube, windows: DataFrame) -> DataFrame:
    """(order, next day) pairs that a window holds whole: ``plan_id, period, side, value, again``."""
    w = windows.select("plan_id", "dimension", "period", "side", F.coalesce("first", F.lit("0001-01-02").cast("date")).alias("first"),
                       F.coalesce("last", F.lit("9999-12-31").cast("date")).alias("last"),
                       (F.col("first").isNull() & F.col("last").isNull()).alias("all"))
    inside = (F.col("day") >= F.col("first")) & (F.col("next_day") <= F.col("last")) | F.col("all")
    return w.join(cube.repeats, "dimension").where(inside).groupBy("plan_id", "period", "side", "value").agg(F.sum("n").alias("again"))


def _metric(side: int) -> Column:
    """The plan's metric from the sums of one side; a sum of nothing is null, as it is for the single operators."""
    of = {c: F.max(F.when(F.col("side") == side, F.col(c))) for c in _SUMS}
    sales = F.when(of["n_sales"] > 0, of["sales"].cast("double"))
    profit = F.when(of["n_profit"] > 0, of["profit"].cast("double"))
    return {"sales": sales, "profit": profit, "orders": F.coalesce(of["orders"], F.lit(0)).cast("double"), "profit_margin": ratio_pct(profit, sales)}


def check_plans(plans: DataFrame) -> DataFrame:
    """The plans with a ``problem`` column: null for a plan that can be answered."""
    def one_of(col, values, null=True):
        known = F.col(col).isin(list(values))
        return F.coalesce(known, F.lit(null))

    intent = F.col("intent")
    problem = F.when(~one_of("intent", ("kpi_value", "kpi_rank", "kpi_trend", "kpi_compare"), False), "intent")
    for bad, name in (
            (~one_of("metric", METRICS, False), "metric"), (~one_of("breakdown_by", DIMENSIONS), "breakdown_by"),
            ((intent == "kpi_rank") & F.col("breakdown_by").isNull(), "breakdown_by"),
            ((intent == "kpi_rank") & ~F.coalesce(F.col("top_k") > 0, F.lit(False)), "top_k"),
            ((intent == "kpi_trend") & ~one_of("time_grain", GRAINS, False), "time_grain"),
            ((intent == "kpi_compare") & ~one_of("compare_period", ("prev_period", "mom", "yoy"), False), "compare_period"),
            ((intent == "kpi_compare") & (F.col("start_date").isNull() | F.col("end_date").isNull()), "start_date"),
            (F.coalesce(F.col("start_date") > F.col("end_date"), F.lit(False)), "end_date")):
        problem = problem.when(bad, name)
    return plans.withColumn("problem", problem)


def answer_plans(lines: DataFrame | DayCube, plans: DataFrame, tasks: int | None = None) -> DataFrame:
    """``plan_id, intent, metric, period, breakdown, current, previous, change_pct, position`` of every answerable plan.

    ``tasks``: see :func:`build_cube`.  ``plans``: the columns of ``PLAN_COLUMNS`` (others are ignored), ``plan_id`` unique.  ``position`` orders a plan's rows as the single
    operator does.  Plans with a problem (:func:`check_plans`) have no rows.
    """
    cube = lines if isinstance(lines, DayCube) else build_cube(lines, tasks=tasks)
    good = shared_table(check_plans(plans.select(*PLAN_COLUMNS)).where("problem IS NULL").drop("problem"), "plans")
    windows = shared_table(_windows(good.where("intent <> 'kpi_trend'")).withColumn("period", F.lit(None).cast("date")).unionByName(
        _trend_windows(good, cube)), "plan-windows")
    sums = _looked_up(cube, windows)
    again = _counted_again(cube, windows)
    keys = ["plan_id", "period", "side", "value"]
    # null-safe on period and value: both are part of the row's name
    met = sums.unionByName(again.select(*keys, *[(-F.col("again") if c == "orders" else F.lit(0)).cast(sums.schema[c].dataType).alias(c) for c in _SUMS]))
    exact = met.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
    now, then = _metric(0), _metric(1)

    def of(parts):
        out = None
        for m, c in parts.items():
            out = F.when(F.col("metric") == m, c) if out is None else out.when(F.col("metric") == m, c)
        return out

    joined = exact.join(good.select("plan_id", "intent", "metric", "breakdown_by", "top_k"), "plan_id")
    seen = F.coalesce(F.max(F.when(F.col("side") == 0, F.col("lines"))), F.lit(0)) > 0
    rows = joined.groupBy("plan_id", "intent", "metric", "breakdown_by", "top_k", "period", "value").agg(
        *[c.alias(f"now_{m}") for m, c in now.items()], *[c.alias(f"then_{m}") for m, c in then.items()], seen.alias("seen"))
    # a window of nothing still has its one row
    alone = good.where("intent IN ('kpi_value', 'kpi_compare') AND breakdown_by IS NULL").select("plan_id", "intent", "metric", "breakdown_by", "top_k")
    rows = rows.unionByName(alone.join(rows.select("plan_id").distinct(), "plan_id", "left_anti"), allowMissingColumns=True)
    current = of({m: F.col(f"now_{m}") for m in METRICS})
    current = F.when(F.col("metric") == "orders", F.coalesce(current, F.lit(0.0))).otherwise(current)
    compare = F.col("intent") == "kpi_compare"
    rows = rows.where((F.col("breakdown_by").isNull() & (F.col("intent") != "kpi_trend")) | F.col("seen")).select(
        "plan_id", "intent", "metric", "top_k", "period", F.col("value").alias("breakdown"),
        F.when(compare, F.coalesce(current, F.lit(0.0))).otherwise(current).alias("current"),
        F.when(compare, F.coalesce(of({m: F.col(f"then_{m}") for m in METRICS}), F.lit(0.0))).alias("previous"))
    rows = rows.withColumn("change_pct", change_pct(F.col("current"), F.col("previous")))
    order = Window.partitionBy("plan_id").orderBy(
        F.col("period").asc_nulls_first(), F.when(F.col("intent") == "kpi_compare", F.col("change_pct")).asc_nulls_last(),
        F.when(F.col("intent").isin("kpi_value", "kpi_rank"), F.col("current")).desc_nulls_last(), F.col("breakdown").asc_nulls_last())
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(
        (F.col("intent") != "kpi_rank") | (F.col("position") <= F.col("top_k"))).drop("top_k")
