"""Verified fact rows (K1-K13): ``(chunk_id, text, metadata)``.

All sums the facts need come from ONE grouping-sets aggregate over the order
lines (year, month, quarter, each dimension, segment x category, discount
buckets and the total).  Partial aggregation shrinks every task's rows to a
few hundred groups before the shuffle, so the scan is the only cost that
grows with the data.  Distinct order counts (year and total only) come from
a second, narrow aggregate.  The result, a row per period, value and bucket,
is written once to the shared folder; its entries are ranked in their set and
gathered by kind of fact.  Nothing is collected to the driver.

Like the reference's pandas code, fact aggregates drop NULL keys and rows
without a parseable date (D17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.numeric import bucket_order, discount_bucket
from kpiforge.functions.text import fixed, money, signed, thousands
from kpiforge.sources.tables import shared_table

FACT_SCHEMA = "chunk_id string, text string, metadata map<string,string>"

# fixed values: the four schema facts, word for word
SCHEMA_FACTS = (
    ("schema_metrics",
     "Queryable metrics: sales (total revenue USD), profit (can be negative), "
     "orders (COUNT DISTINCT order_id), profit_margin (profit/sales × 100, %)."),
    ("schema_dimensions",
     "Supported breakdowns: region, segment, category, sub_category. "
     "Time grains: week, month, quarter, year."),
    ("schema_compare",
     "Period comparisons: yoy (vs same period last year), "
     "mom (vs prior month), prev_period (vs prior window of equal length)."),
    ("schema_intents",
     "Supported query intents: kpi_value (aggregates), kpi_trend (time series), "
     "kpi_rank (top-k by dimension), kpi_compare (period-over-period)."),
)

# fixed values: top-k facts built (dimension, k)
TOP_K_FACTS = (("sub_category", 10), ("category", 5), ("region", 4))
DIM_FACTS = ("region", "segment", "category")

# SQL of the list texts of facts: [1995, 1996] / ['AFRICA', 'ASIA']; a value with an apostrophe stands in double quotes
# unless it holds both kinds of quotes
_QUOTED = ("""if(contains(v, "'") AND NOT contains(v, '"'), concat('"', replace(v, '\\\\', '\\\\\\\\'), '"'), """
           """concat("'", replace(replace(v, '\\\\', '\\\\\\\\'), "'", "\\\\'"), "'"))""")


def _values(rows: str, quote: bool) -> str:
    return f"concat('[', array_join({f'transform({rows}, v -> {_QUOTED})' if quote else rows}, ', '), ']')"


def fact_aggregates(df: DataFrame) -> DataFrame:
    """The shared aggregate: one row per (set, key1, key2).

    Columns: ``set`` (see the branches below), ``k1``/``k2`` (string keys; period
    start dates for time sets), ``sales``/``profit`` (exact DECIMAL sums),
    ``n_sales``/``n_profit`` (non-NULL counts), ``min_date``/``max_date``.

    One level on purpose: every task expands its lines into the ten sets
    but keeps only ~200 groups in its partial aggregate, so the shuffle is
    ~200 rows per task.  Pre-aggregating to the base grain first (month x
    dimensions x bucket) would shuffle up to a million groups per task and
    was measured slower.
    """
    d = F.col("order_date")
    base = df.select(
        F.year(d).alias("year"), F.trunc(d, "month").alias("month"), F.trunc(d, "quarter").alias("quarter"),
        "region", "segment", "category", "sub_category",
        discount_bucket(F.col("discount")).alias("raw"), discount_bucket(F.col("discount") / 100).alias("pct"),
        "discount", "sales", "profit", d.alias("order_date"))
    keys = ["year", "month", "quarter", "region", "segment", "category", "sub_category", "raw", "pct"]
    sets = [[F.col(k)] for k in keys] + [[F.col("segment"), F.col("category")], []]
    g = base.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"),
        F.count("sales").alias("n_sales"), F.count("profit").alias("n_profit"),
        F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"), F.max("discount").alias("max_discount"),
        F.grouping_id(*[F.col(k) for k in keys]).alias("_gid"))
    n = len(keys)
    full = (1 << n) - 1

    def only(*present: str) -> int:
        m = full
        for k in present:
            m ^= 1 << (n - 1 - keys.index(k))
        return m

    set_name = F.lit(None).cast("string")
    k1 = F.lit(None).cast("string")
    k2 = F.lit(None).cast("string")
    for name, present in (("year", ("year",)), ("month", ("month",)), ("quarter", ("quarter",)),
                          ("region", ("region",)), ("segment", ("segment",)),
                          ("category", ("category",)), ("sub_category", ("sub_category",)),
                          ("segment_category", ("segment", "category")), ("raw", ("raw",)), ("pct", ("pct",)),
                          ("total", ())):
        hit = F.col("_gid") == only(*present)
        set_name = F.when(hit, F.lit(name)).otherwise(set_name)
        if present:
            k1 = F.when(hit, F.col(present[0]).cast("string")).otherwise(k1)
        if len(present) > 1:
            k2 = F.when(hit, F.col(present[1]).cast("string")).otherwise(k2)
    return g.select(set_name.alias("set"), k1.alias("k1"), k2.alias("k2"), "sales", "profit",
                    "n_sales", "n_profit", "min_date", "max_date", "max_discount")


def order_counts(df: DataFrame) -> DataFrame:
    """Distinct orders per year and in total: (set, k1, orders)."""
    y = df.select(F.year("order_date").alias("year"), "order_id")
    g = y.groupingSets([[F.col("year")], []], F.col("year")).agg(
        F.count_distinct("order_id").alias("orders"), F.grouping_id().alias("_gid"))
    return g.select(F.when(F.col("_gid") == 0, F.lit("year")).otherwise(F.lit("total")).alias("set"),
                    F.col("year").cast("string").alias("k1"), "orders")


def fact_entries(df: DataFrame) -> DataFrame:
    """Both aggregates as one small table: (set, k1, k2, s, p, ns, np, lo, hi, md, orders), written once."""
    agg = fact_aggregates(df)
    orders = order_counts(df)
    key = F.coalesce(F.col("k1"), F.lit(""))
    # both sides are a few hundred rows; the planner broadcasts one of them
    a = agg.withColumn("_key", key).join(orders.select("set", key.alias("_key"), "orders"), ["set", "_key"], "left")
    return shared_table(a.select(
        "set", "k1", "k2", F.col("sales").alias("s"), F.col("profit").alias("p"), F.col("n_sales").alias("ns"),
        F.col("n_profit").alias("np"), F.col("min_date").alias("lo"), F.col("max_date").alias("hi"),
        F.col("max_discount").alias("md"), "orders"), "fact-entries")


# ── texts: SQL over the entries of a kind of fact (``rows``), whose numbers are formatted before they are gathered ──

_FACT = "array<struct<chunk_id:string,text:string,metadata:map<string,string>>>"


def _fact(cond: str, chunk_id: str, text: list[str], **meta) -> str:
    """An array of one fact where ``cond`` holds, else of none; ``text``: SQL of its parts."""
    pairs = ", ".join(f"'{k}', {v}" if k in ("years", "values") else f"'{k}', '{v}'" for k, v in meta.items())
    return f"if({cond}, array(struct('{chunk_id}' AS chunk_id, concat({', '.join(text)}) AS text, map({pairs}) AS metadata)), cast(array() as {_FACT}))"


def _listed(rows: str, parts: list[str]) -> str:
    """The texts of entries (``r``), put together with semicolons."""
    return f"array_join(transform({rows}, r -> concat({', '.join(parts)})), '; ')"


def _set(*names: str) -> str:
    return f"filter(rows, r -> r.set IN ({', '.join(map(repr, names))}) AND r.k1 IS NOT NULL)"


_TOTAL = "get(filter(rows, r -> r.set = 'total'), 0)"


def _total(field: str, otherwise: str = "'$0'") -> str:
    return f"coalesce({_TOTAL}.{field}, {otherwise})"


def _const_facts(filters: dict | None) -> Column:
    """K1 + K2: schema facts and the filter context (constants)."""
    f = filters or {}
    dr = f.get("date_range") or ()
    parts = [f"Date range: {dr[0]} to {dr[1]}" if len(dr) == 2 else "Date range: full history"]
    for label, key in (("Region", "region"), ("Segment", "segment"), ("Category", "category")):
        if f.get(key):
            parts.append(f"{label}: {', '.join(str(v) for v in f[key])}")
    items = [(cid, text, "schema") for cid, text in SCHEMA_FACTS]
    items.append(("filter_context", "Current dashboard filters: " + "; ".join(parts) + ".", "filter"))
    return F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(t).alias("text"), F.create_map(F.lit("type"), F.lit(k)).alias("metadata"))
                     for c, t, k in items])


def _kpi_facts() -> str:
    """K3: KPI summary and profitability (also for an empty table: zeros)."""
    sales, profit, margin = _total("sales_text"), _total("profit_text"), _total("margin2", "'0.00'")
    return "concat(" + ", ".join((
        _fact("true", "kpi_summary", ["'KPI summary (current filters): Total Sales='", sales, "', Total Profit='", profit, "', Total Orders='",
                                      _total("orders_text", "'0'"), "', Profit Margin='", margin, "'%.'"], type="kpi"),
        _fact("true", "kpi_profitability", ["'Net profit '", profit, "' on revenue '", sales, "' → margin '", margin, "'%. '",
                                            f"if(coalesce({_TOTAL}.p, 0) > 0, 'Profitable.', 'Operating at a loss.')"],
              type="kpi", topic="profitability"))) + ")"


def _time_range_fact() -> str:
    """K4: date span, list of years, number of months."""
    years = f"transform({_set('year')}, r -> r.k1)"
    return _fact(f"{_TOTAL}.lo IS NOT NULL", "time_range", [
        "'Data spans '", f"{_TOTAL}.lo", "' to '", f"{_TOTAL}.hi", "'. '", f"size({years})", "' years: '", _values(years, False), "'. '",
        f"size({_set('month')})", "' months total.'"], type="time", years=_values(years, False))


def _yearly_facts() -> str:
    """K5 (one per year), K6 (year-over-year changes), K7 (first -> last growth)."""
    years, first, last = _set("year"), f"element_at({_set('year')}, 1)", f"element_at({_set('year')}, -1)"
    each = (f"transform({years}, r -> struct(concat('yearly_', r.k1) AS chunk_id, concat('Year ', r.k1, ': Sales=', r.sales_text, ', Profit=', "
            "r.profit_text, ', Orders=', coalesce(r.orders_text, '0'), ', Margin=', r.margin1, '%.') AS text, "
            "map('type', 'trend', 'grain', 'year', 'year', r.k1) AS metadata))")
    pairs = _listed(f"filter({years}, r -> r.before IS NOT NULL)", ["r.before", "'→'", "r.k1", "': Sales '", "r.sales_change", "'%, Profit '", "r.profit_change", "'%'"])
    several = f"size({years}) >= 2"
    return "concat(" + ", ".join((
        each, _fact(several, "yoy_comparison", ["'Year-over-year changes: '", pairs, "'.'"], type="trend", topic="yoy"),
        _fact(several, "yearly_growth", ["'Revenue growth '", f"{first}.k1", "'→'", f"{last}.k1", "': '", f"{last}.growth", "'% ('",
                                         f"{first}.sales_text", "' → '", f"{last}.sales_text", "').'"], type="trend", topic="growth"))) + ")"


def _monthly_fact(best: bool) -> str:
    """K8: best month by sales; worst month by profit if it is a loss (earliest on ties)."""
    month = "substring(rows[0].k1, 1, 7)"  # yyyy-MM of the month start
    if best:
        return _fact("size(rows) > 0", "monthly_best_sales", ["'Peak month by sales: '", month, "' — '", "rows[0].sales_text", "', profit '",
                                                              "rows[0].profit_text", "'.'"], type="time", grain="month")
    return _fact("coalesce(get(rows, 0).p < 0, false)", "monthly_worst_profit", ["'Worst month by profit: '", month, "' — '", "rows[0].profit_text", "'.'"],
                 type="time", grain="month")


def _quarterly_fact() -> str:
    """K9: the last 8 quarters, oldest first."""
    each = _listed("rows", ["year(cast(r.k1 as date))", "'Q'", "quarter(cast(r.k1 as date))", "': Sales='", "r.sales_text", "', Profit='", "r.profit_text"])
    return _fact("size(rows) > 0", "quarterly_summary", ["'Last 8 quarters: '", each, "'.'"], type="trend", grain="quarter")


def _dimension_fact(dim: str) -> str:
    """Sorted value list and per-value sales / profit, highest sales first."""
    values = _values(f"sort_array(transform({_set(dim)}, r -> r.k1))", True)
    each = _listed(_set(dim), ["r.k1", "': Sales='", "r.sales_text", "', Profit='", "r.profit_text"])
    return _fact(f"size({_set(dim)}) > 0", f"dim_{dim}", [f"'Dimension \\'{dim}\\' values: '", values, "'. Detail: '", each, "'.'"],
                 type="dimension", dimension=dim, values=values)


def _top_k_fact(dim: str, k: int, metric: str) -> str:
    """Top k values of a dimension by profit or by sales (ties: value order); ``rows`` holds those k."""
    each = f"array_join(transform(rows, r -> concat(r.k1, ' (', r.{metric}_text, ')')), ', ')"
    return _fact("size(rows) > 0", f"top{k}_{dim}_{metric}", [f"'Top {k} {dim.replace('_', ' ')} by {metric}: '", each, "'.'"],
                 type="rank", dimension=dim, metric=metric, k=k)


def _discount_fact() -> str:
    """Mean profit, mean sales and line count per discount bucket; as percentages if the largest discount says so."""
    found = f"filter({_set('raw', 'pct')}, r -> r.np > 0 AND r.set = if(coalesce({_TOTAL}.md > 1, false), 'pct', 'raw'))"
    each = _listed(found, ["'Discount '", "r.k1", "': avg profit='", "r.mean_profit", "', avg sales='", "r.mean_sales", "' ('", "r.np", "' orders)'"])
    return _fact(f"size({found}) > 0", "discount_impact", ["'Discount impact on profit: '", each, "'.'"], type="insight", topic="discount")


def _segment_category_fact(n: int = 9) -> str:
    """The ``n`` segment x category pairs with the highest profit; ``rows`` holds those n."""
    each = _listed("rows", ["r.k1", "'/'", "r.k2", "': Profit='", "r.profit_text"])
    return _fact("size(rows) > 0", "segment_category_cross", [f"'Top {n} Segment×Category combos by profit: '", each, "'.'"],
                 type="cross", dimensions="segment,category")


def _kinds() -> list[tuple[str, str, str]]:
    """The kinds of facts in the reference's order, in SQL: which ranked entries belong to one, their order, the facts made of
    those entries."""
    def first(k: int, rank: str, name: str) -> str:
        return f"set = '{name}' AND k1 IS NOT NULL AND {rank} <= {k}"

    out = [("set IN ('none', 'total')", "0", _kpi_facts()), ("set IN ('total', 'year', 'month')", "-by_key", _time_range_fact()),
           ("set = 'year'", "-by_key", _yearly_facts()), (first(1, "by_sales", "month"), "0", _monthly_fact(True)),
           (first(1, "by_loss", "month"), "0", _monthly_fact(False)), (first(8, "by_key", "quarter"), "-by_key", _quarterly_fact())]
    out += [(f"set = '{d}'", "by_sales", _dimension_fact(d)) for d in DIM_FACTS]
    out += [(first(k, f"by_{m}", d), f"by_{m}", _top_k_fact(d, k, m)) for d, k in TOP_K_FACTS for m in ("profit", "sales")]
    out += [("set IN ('total', 'raw', 'pct')", "bucket", _discount_fact()),
            (first(9, "by_profit", "segment_category") + " AND k2 IS NOT NULL", "by_profit", _segment_category_fact())]
    return out


def _ranked(entries: DataFrame) -> DataFrame:
    """Entries with their ranks in their set and their numbers as text: one exchange, by set."""
    missing = F.expr("k1 IS NULL OR (set = 'segment_category' AND k2 IS NULL)")
    s, p = F.expr("coalesce(cast(s as double), 0D)"), F.expr("coalesce(cast(p as double), 0D)")

    def rank(*order):
        return F.row_number().over(Window.partitionBy("set").orderBy(missing, *order, "k1", "k2"))

    numbered = entries.withColumns({"ds": s, "dp": p}).withColumns({
        "by_sales": rank(-F.col("ds")), "by_profit": rank(-F.col("dp")), "by_loss": rank(F.col("dp")), "by_key": rank(F.col("k1").desc())})
    time = Window.partitionBy("set").orderBy(missing, F.col("by_key").desc())  # years in order
    numbered = numbered.withColumns({"before": F.lag("k1").over(time), "s0": F.lag("ds").over(time), "p0": F.lag("dp").over(time),
                                     "s1": F.first("ds").over(time.rowsBetween(Window.unboundedPreceding, 0))})
    margin = F.expr("if(ds != 0, dp / ds * 100, 0D)")
    return numbered.withColumns({
        "bucket": bucket_order(F.col("k1")), "sales_text": money(F.col("ds")), "profit_text": money(F.col("dp")), "orders_text": thousands(F.col("orders")),
        "margin1": fixed(margin, 1), "margin2": fixed(margin, 2), "mean_sales": money(F.expr("try_divide(cast(s as double), ns)")),
        "mean_profit": money(F.expr("try_divide(cast(p as double), np)")),
        "sales_change": signed(F.expr("if(s0 != 0, (ds - s0) / s0 * 100, 0D)"), 1),
        "profit_change": signed(F.expr("if(p0 != 0, (dp - p0) / abs(p0) * 100, 0D)"), 1),
        "growth": signed(F.expr("if(s1 != 0, (ds - s1) / s1 * 100, 0D)"), 1)})


_ENTRY = ("set, k1, k2, p, np, md, lo, hi, before, sales_text, profit_text, orders_text, margin1, margin2, mean_sales, mean_profit, "
          "sales_change, profit_change, growth")


def build_facts(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """All facts (K1-K13) as rows ``(chunk_id, text, metadata)``, in the
    reference's order of kinds.

    The lines are read twice, by the grouping-sets aggregate and by the
    distinct-count aggregate (:func:`fact_entries`, run here).  Their result is
    ranked in every set (one exchange, by set), each entry goes to the kinds of
    facts it belongs to, and a kind is one row with the entries its text names
    (U1): one pass, however many kinds there are.
    """
    t = fact_entries(df)
    none = t.sparkSession.range(1).select(F.lit("none").alias("set"))  # a table without lines still has a KPI summary
    kinds = _kinds()
    member = ", ".join(f"if({holds}, struct({k} AS kind, {order} AS pos), NULL)" for k, (holds, order, _) in enumerate(kinds))
    gathered = _ranked(t.unionByName(none, allowMissingColumns=True)).selectExpr(
        f"inline(filter(array({member}), k -> k IS NOT NULL))", f"struct({_ENTRY}) AS entry").groupBy("kind").agg(
        F.expr("transform(sort_array(collect_list(struct(pos, entry))), x -> x.entry)").alias("rows"))
    facts = F.expr("CASE " + " ".join(f"WHEN kind = {k} THEN {build}" for k, (_, _, build) in enumerate(kinds)) + " END")
    facts = F.concat(F.when(F.col("kind") == 0, _const_facts(filters)).otherwise(F.array().cast(_FACT)), facts)
    # a fact for each year, value and kind at most: few rows
    return gathered.select("kind", F.posexplode(facts).alias("at", "f")).coalesce(1).sortWithinPartitions("kind", "at").select(
        "f.chunk_id", "f.text", "f.metadata")


# ── numeric views of single facts (for checks and callers that want numbers) ──

def time_range(df: DataFrame) -> DataFrame:
    """K4 as numbers: min/max date, years (comma list), number of years and months."""
    v = df.filter(F.col("order_date").isNotNull())
    return v.agg(F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"),
                 F.array_join(F.transform(F.sort_array(F.collect_set(F.year("order_date"))),
                                          lambda y: y.cast("string")), ", ").alias("years"),
                 F.count_distinct(F.year("order_date")).alias("n_years"),
                 F.count_distinct(F.trunc("order_date", "month")).alias("n_months"))


def last_quarters(df: DataFrame, n: int = 8) -> DataFrame:
    """K9 as numbers: the last ``n`` quarters (label like ``2001Q3``), sales, profit."""
    q = (df.filter(F.col("order_date").isNotNull())
           .groupBy(F.trunc("order_date", "quarter").alias("q"))
           .agg(F.sum("sales").cast("double").alias("sales"),
                F.coalesce(F.sum("profit").cast("double"), F.lit(0.0)).alias("profit"))
           .orderBy(F.col("q").desc()).limit(n))
    return q.select(F.concat(F.year("q").cast("string"), F.lit("Q"), F.quarter("q").cast("string")).alias("quarter"),
                    "sales", "profit").orderBy("quarter")


def best_worst_month(df: DataFrame) -> DataFrame:
    """K8 as numbers: best month by sales and worst by profit (NULL unless a loss)."""
    m = (df.filter(F.col("order_date").isNotNull())
           .groupBy(F.trunc("order_date", "month").alias("m"))
           .agg(F.sum("sales").alias("s"), F.coalesce(F.sum("profit"), F.lit(0)).alias("p")))
    r = m.agg(F.max_by(F.struct("m", "s", "p"), F.struct(F.col("s"), -F.unix_date("m"))).alias("b"),
              F.min_by(F.struct("m", "p"), F.struct(F.col("p"), F.unix_date("m"))).alias("w"))
    worst = F.col("w.p") < 0
    return r.select(F.date_format("b.m", "yyyy-MM").alias("best_month"),
                    F.col("b.s").cast("double").alias("best_sales"),
                    F.col("b.p").cast("double").alias("best_profit"),
                    F.when(worst, F.date_format("w.m", "yyyy-MM")).alias("worst_month"),
                    F.when(worst, F.col("w.p").cast("double")).alias("worst_profit"))


def segment_category_top(df: DataFrame, n: int = 9) -> DataFrame:
    """K13 as numbers: rank, segment, category, profit, sales."""
    g = (df.filter(F.col("segment").isNotNull() & F.col("category").isNotNull())
           .groupBy("segment", "category")
           .agg(F.coalesce(F.sum("profit").cast("double"), F.lit(0.0)).alias("profit"),
                F.coalesce(F.sum("sales").cast("double"), F.lit(0.0)).alias("sales")))
    w = Window.orderBy(F.col("profit").desc(), F.col("segment"), F.col("category"))
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)

