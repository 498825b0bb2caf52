"""Question-log tagging (G1-G10): the reference's per-question rules, applied
to a whole column of questions as one Spark job.

Input ``(id, text)``; output one row per question with the tags a rule-based
planner would derive: metrics, breakdown, grain, compare period, top-k,
loss / extremes / growth-rank flags, date window, mentioned dimension values,
intent and the fast-KPI label.  Only built-in string, regex, array and date
functions; no UDF.

Values named in a question (G8) are found by an equi-join: every distinct
question is cut into its 3-letter (for shorter values 2- and 1-letter) parts,
which meet the values that begin with them; only those pairs are tested for
the whole value.  Values and date bounds come from one aggregate over the
order lines, written once to the shared folder.  Relative windows ("past 30
days") end at the latest order date of that table (a scalar subquery).

Regexes are Java regexes with the same text as the reference's Python ones;
``\\b`` and ``(?i)`` behave the same on ASCII text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.metrics import DIMENSIONS
from kpiforge.sources.tables import shared_table

# ── fixed values: keyword tables (keyword -> value), in the reference's order ──
METRIC_KEYWORDS = {
    "sale": "sales", "sales": "sales", "revenue": "sales", "income": "sales",
    "profit": "profit", "margin": "profit_margin", "profit margin": "profit_margin",
    "profitability": "profit_margin",
    "order": "orders", "orders": "orders", "transaction": "orders",
}
BREAKDOWN_KEYWORDS = {
    "region": "region", "regions": "region",
    "segment": "segment", "segments": "segment",
    "category": "category", "categories": "category",
    "sub-category": "sub_category", "subcategory": "sub_category",
    "sub_category": "sub_category", "sub category": "sub_category",
    "subcategories": "sub_category", "sub-categories": "sub_category",
    "product": "sub_category",
    "state": "state", "states": "state", "province": "state",
}
GRAIN_KEYWORDS = {
    "daily": "week", "weekly": "week", "week": "week",
    "monthly": "month", "month": "month",
    "quarterly": "quarter", "quarter": "quarter",
    "yearly": "year", "annual": "year", "year": "year",
}
COMPARE_KEYWORDS = {
    "yoy": "yoy", "year over year": "yoy", "year-over-year": "yoy",
    "same period last year": "yoy", "same period": "yoy",
    "same time last year": "yoy", "prior year": "yoy", "last year": "yoy",
    "mom": "mom", "month over month": "mom", "month-over-month": "mom",
    "previous period": "prev_period", "prior period": "prev_period",
    "last period": "prev_period", "vs previous": "prev_period",
}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3,
    "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

# ── fixed values: patterns (same text as the reference; (?i) where it ignores case) ──
DETAIL_NEGATIVE = (r"(?i)\b(negative\s+profit|loss[\s-]?making|at\s+a\s+loss|generating\s+loss"
                   r"|which\s+orders|which\s+products|which\s+items"
                   r"|losing\s+money|unprofitable|loss\s+orders"
                   r"|negative\s+margin|profit\s+<\s*0|profit\s+is\s+negative"
                   r"|what.*generating.*loss|what.*causing.*loss)\b")
EXTREMES = (r"(?i)\b(highest.*lowest|lowest.*highest|best.*worst|worst.*best"
            r"|top.*bottom|bottom.*top|maximum.*minimum|min.*max"
            r"|most.*least|least.*most)\b")
SUPERLATIVE = r"(?i)\b(best|highest|most|top|leading|greatest|biggest|largest|number\s*one)\b"
GENERAL_YOY = r"(?i)\b(how\s+did|show|display|what\s+is|trend|change|growth|evolve|progress)\b"
BREAKDOWN_PHRASE = (r"(?i)\b(by|per|across|for each|breakdown|group by|split by)\s+"
                    r"(region|segment|category|sub.?category|product|state|city|ship\s*mode)\b")
TOP_N = r"\btop[\s-]?(\d+)\b"
COMPARE_WORD = r"\b(compare|vs|versus|compared)\b"
TIME_YEAR = r"\b(20\d{2})\b"
TIME_YM = r"\b(\d{4}[-/](0?[1-9]|1[0-2]))\b"
TIME_GRAIN = r"\b(q[1-4]|quarter|month|year|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"
TIME_REL = r"\b(in|during|between|from|since|until|last|previous|this)\b"
QUARTER_YEAR = r"(?i)\bq([1-4])\s*(20\d{2})\b"
RELATIVE = (r"(?i)\b(?:past|last|previous|over\s+(?:the\s+)?past)\s+(\d+)\s*(day|week|month|year)s?\b"
            r"|\b(this|current)\s+(week|month|quarter|year)\b")
THIS_PERIOD = r"(?i)\b(this|current)\s+(week|month|quarter|year)\b"
GROWTH_RANK = (r"(?i)\b(strongest|highest|most|best|biggest|largest|fastest)\s+"
               r"(growth|increase|improvement|gain|rise|growing)\b"
               r"|\b(growth|increase|improvement)\s+(?:by|per|across|for each)\b")
NUMERIC_DATE = r"\b(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
DATE_RANGE = (r"(?i)\b(\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4})\s*(?:to|until|–|—|-{1,2})\s*"
              r"(\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4})\b")
FAST_SUMMARY = r"\b(kpi|summary|overview|dashboard)\b"
FAST_SALES = r"\b(total\s+sales|sales\s+total|revenue)\b"
FAST_PROFIT = r"\b(total\s+profit|profit\s+total)\b"
FAST_ORDERS = r"\b(total\s+orders|orders\s+total|number\s+of\s+orders)\b"
FAST_MARGIN = r"\b(profit\s+margin|margin)\b"
MONTH_YEAR = (r"(?i)\b(?:(" + "|".join(MONTHS) + r")\s+(20\d{2})|(20\d{2})\s+(" + "|".join(MONTHS) + r"))\b")

VALUE_DIMS = ("region", "segment", "category", "sub_category")


def longest_first(table: dict) -> list[tuple[str, str]]:
    """Keyword entries, longest keyword first (ties keep table order)."""
    return sorted(table.items(), key=lambda kv: -len(kv[0]))


def _kw_array(table: dict) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(v).alias("val")) for k, v in longest_first(table)])


def keyword_hits(ql: Column, table: dict) -> Column:
    """Values of every keyword contained in ``ql``, longest keyword first."""
    return F.transform(F.filter(_kw_array(table), lambda x: F.instr(ql, x["kw"]) > 0), lambda x: x["val"])


def first_keyword(ql: Column, table: dict) -> Column:
    return F.get(keyword_hits(ql, table), 0)


def _found(s: Column) -> Column:
    return F.when(s != "", s)


def parse_numeric_date(s: Column) -> Column:
    """D-e: ``Y-M-D`` when the first part has 4 digits; else ``D/M/Y`` then ``M/D/Y``."""
    parts = F.split(F.regexp_replace(s, r"[/.]", "-"), "-")
    a, b, c = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    def zfill2(x):  # lpad would also cut longer strings
        return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)

    ymd = F.try_to_date(F.concat_ws("-", a, zfill2(b), zfill2(c)), "yyyy-MM-dd")
    ai, bi = a.cast("int"), b.cast("int")

    def day(y, m, d):
        return F.try_to_date(F.concat_ws("-", y, m.cast("string"), d.cast("string")), "y-M-d")

    dmy = F.when(ai.between(1, 31) & bi.between(1, 12), day(c, bi, ai))
    mdy = F.when(ai.between(1, 12) & bi.between(1, 31), day(c, ai, bi))
    return (F.when(F.size(parts) != 3, F.lit(None).cast("date"))
             .when(F.length(a) == 4, ymd)
             .when(F.length(c) == 4, F.coalesce(dmy, mdy)))


def _window(start: Column, end: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def _sorted_pair(d1: Column, d2: Column) -> Column:
    return F.struct(F.least(d1, d2).alias("start"), F.greatest(d1, d2).alias("end"))


def explicit_window(ql: Column) -> Column:
    """G7 without relative phrases: struct(start, end) or NULL."""
    r1 = parse_numeric_date(_found(F.regexp_extract(ql, DATE_RANGE, 1)))
    r2 = parse_numeric_date(_found(F.regexp_extract(ql, DATE_RANGE, 2)))
    rng = _window(F.least(r1, r2), F.greatest(r1, r2), r1.isNotNull() & r2.isNotNull())

    dates = F.filter(F.transform(F.regexp_extract_all(ql, F.lit(NUMERIC_DATE), 0), parse_numeric_date),
                     lambda d: d.isNotNull())
    n = F.size(dates)
    two = F.when(n == 2, _sorted_pair(F.get(dates, 0), F.get(dates, 1)))
    one = _window(F.get(dates, 0), F.get(dates, 0), n == 1)

    month_map = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    mname = F.lower(F.coalesce(_found(F.regexp_extract(ql, MONTH_YEAR, 1)), _found(F.regexp_extract(ql, MONTH_YEAR, 4))))
    myear = F.coalesce(_found(F.regexp_extract(ql, MONTH_YEAR, 2)), _found(F.regexp_extract(ql, MONTH_YEAR, 3)))
    mstart = F.make_date(myear.cast("int"), F.element_at(month_map, mname), F.lit(1))
    my = F.when(mname.isNotNull() & myear.isNotNull(),
                F.struct(mstart.alias("start"), F.last_day(mstart).alias("end")))

    qn = _found(F.regexp_extract(ql, QUARTER_YEAR, 1))
    qy = F.regexp_extract(ql, QUARTER_YEAR, 2)
    qstart = F.make_date(qy.cast("int"), (qn.cast("int") - 1) * 3 + 1, F.lit(1))
    qw = F.when(qn.isNotNull(), F.struct(qstart.alias("start"),
                                         F.last_day(F.add_months(qstart, 2)).alias("end")))

    years = F.regexp_extract_all(ql, F.lit(TIME_YEAR), 1)
    y = F.get(years, 0).cast("int")
    yw = F.when(F.size(years) == 1, F.struct(F.make_date(y, F.lit(1), F.lit(1)).alias("start"),
                                             F.make_date(y, F.lit(12), F.lit(31)).alias("end")))
    return F.coalesce(rng, two, one, my, qw, yw)


def relative_window(ql: Column, anchor: Column) -> Column:
    """F7 / F8 from text: "past N day|week|month|year", "this|current week|month|quarter|year"."""
    n = _found(F.regexp_extract(ql, RELATIVE, 1)).cast("int")
    unit = F.lower(F.regexp_extract(ql, RELATIVE, 2))
    grain = F.lower(F.regexp_extract(ql, RELATIVE, 4))
    start_n = (F.when(unit == "day", F.date_sub(anchor, n))
                .when(unit == "week", F.date_sub(anchor, n * 7))
                .when(unit == "month", F.add_months(anchor, -n))
                .when(unit == "year", F.add_months(anchor, -n * 12)))
    start_this = None
    for g in ("week", "month", "quarter", "year"):
        start_this = (F.when(grain == g, F.trunc(anchor, g)) if start_this is None
                      else start_this.when(grain == g, F.trunc(anchor, g)))
    start = F.coalesce(F.when(n.isNotNull(), start_n), start_this)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), anchor.alias("end")))


def dimension_values(order_lines: DataFrame) -> DataFrame:
    """``(dim, value, lo, hi)``: the values of each dimension (NULL among them) with their date bounds, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in VALUE_DIMS]))
    rows = order_lines.select("order_date", pairs.alias("p")).select("order_date", "p.dim", "p.value")
    return shared_table(rows.groupBy("dim", "value").agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")),
                        "question-values")


def mentions(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Per distinct question ``ql``: for each dimension the values named as whole words (``m_<dim>``, sorted) and whether
    values occur in it at all (``s_<dim>``); both empty / false when every value of the dimension does, as it is no filter then."""
    q = questions.select("ql").distinct()
    part = F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("ql"), F.lit(1))),
        lambda i: F.array(*[F.substring(F.col("ql"), i, F.lit(n)) for n in (1, 2, 3)])))))
    v = values.filter(F.length("value") > 0).select("dim", "value", F.lower("value").alias("_v"))
    v = v.withColumn("_part", F.substring("_v", 1, 3))
    hits = q.select("ql", part.alias("_part")).join(v, "_part").filter(F.instr(F.col("ql"), F.col("_v")) > 0)
    whole = F.regexp_like("ql", F.concat(F.lit(r"\b\Q"), F.col("_v"), F.lit(r"\E\b")))
    hits = hits.select("ql", "dim", F.when(whole, F.col("value")).alias("_w"))
    counts = values.filter(F.col("value").isNotNull()).groupBy("dim").agg(F.count(F.lit(1)).alias("_all"))  # a row a dimension
    per = (hits.groupBy("ql", "dim").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_w")).alias("_w"))
               .join(counts, "dim"))
    none = F.array().cast("array<string>")
    return per.groupBy("ql").agg(
        *[F.coalesce(F.max(F.when((F.col("dim") == d) & (F.size("_w") < F.col("_all")), F.col("_w"))), none).alias(f"m_{d}") for d in VALUE_DIMS],
        *[F.coalesce(F.max((F.col("dim") == d) & (F.col("_n") < F.col("_all"))), F.lit(False)).alias(f"s_{d}") for d in VALUE_DIMS])


def tag_questions(questions: DataFrame, order_lines: DataFrame, id_col: str = "id",
                  text_col: str = "text") -> DataFrame:
    """G1-G10 for every question.  See the module docstring."""
    values = dimension_values(order_lines)
    bounds = values.agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi"))).scalar()
    q = questions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("q"))
    q = q.withColumn("ql", F.trim(F.lower("q")))
    q = q.join(mentions(q, values), "ql", "left").withColumn("_hi", bounds["hi"])
    ql = F.col("ql")

    t = (q
         .withColumn("is_loss", F.col("q").rlike(DETAIL_NEGATIVE))
         .withColumn("is_extremes", F.col("q").rlike(EXTREMES))
         .withColumn("is_growth_rank", F.col("q").rlike(GROWTH_RANK))
         .withColumn("_metrics", F.array_distinct(keyword_hits(ql, METRIC_KEYWORDS)))
         .withColumn("_kw_dim", first_keyword(ql, BREAKDOWN_KEYWORDS))
         .withColumn("_explicit", explicit_window(ql))
         .withColumn("_relative", relative_window(ql, F.col("_hi"))))

    metrics = F.when(F.size("_metrics") == 0, F.array(F.lit("sales"))).otherwise(F.slice("_metrics", 1, 2))
    raw = F.regexp_replace(F.lower(F.regexp_extract(F.col("q"), BREAKDOWN_PHRASE, 2)), "[ -]", "_")
    raw = F.when(raw.contains("sub"), F.lit("sub_category")).otherwise(raw)
    phrase_dim = F.when(raw.isin(*DIMENSIONS), raw)
    value_dim = (F.when(F.col("s_sub_category"), F.lit("sub_category")).when(F.col("s_region"), F.lit("region"))
                  .when(F.col("s_segment"), F.lit("segment")).when(F.col("s_category"), F.lit("category")))
    top_n = _found(F.regexp_extract(ql, TOP_N, 1)).cast("int")
    grain_kw = first_keyword(ql, GRAIN_KEYWORDS)
    cmp_kw = first_keyword(ql, COMPARE_KEYWORDS)

    t = (t.withColumn("metrics", metrics)
          .withColumn("_dim", F.coalesce(F.col("_kw_dim"), phrase_dim, value_dim))
          .withColumn("_dates", F.coalesce(F.col("_explicit"), F.col("_relative")))
          # "best ..." means the first one only of a dimension that is asked for, not of one whose value is named
          .withColumn("_top", F.coalesce(top_n, F.when(
              F.col("q").rlike(SUPERLATIVE) & F.coalesce(F.col("_kw_dim"), phrase_dim).isNotNull(), F.lit(1))))
          .withColumn("_grain", F.when(F.col("_dates").isNotNull() & F.col("q").rlike(THIS_PERIOD), F.lit(None))
                      .otherwise(grain_kw))
          .withColumn("_cmp", F.coalesce(cmp_kw, F.when(ql.rlike(COMPARE_WORD), F.lit("prev_period")))))

    dim, dates, cmp = F.col("_dim"), F.col("_dates"), F.col("_cmp")
    has_dates = dates.isNotNull()
    intent = (F.when(F.col("is_loss"), F.lit("kpi_detail"))
               .when(F.col("is_growth_rank") & dim.isNotNull(), F.lit("kpi_rank"))
               .when((cmp == "yoy") & ~has_dates, F.lit("kpi_trend"))
               .when(cmp == "mom", F.lit("kpi_trend"))
               .when(cmp.isNotNull(), F.lit("kpi_compare"))
               .when(F.col("_top").isNotNull() & dim.isNotNull(), F.lit("kpi_rank"))
               .when(F.col("_grain").isNotNull(), F.lit("kpi_trend"))
               .when(dim.isNotNull(), F.lit("kpi_value"))
               .when(has_dates | (F.size("metrics") > 1), F.lit("kpi_value")))
    path = (F.when(F.col("is_loss"), "detail").when(F.col("is_growth_rank") & dim.isNotNull(), "growth")
             .when((cmp == "yoy") & ~has_dates & F.col("q").rlike(GENERAL_YOY), "yoy_general")
             .when((cmp == "yoy") & ~has_dates, "yoy").when(cmp == "mom", "mom"))
    t = t.withColumn("intent", intent).withColumn("_path", path)
    p = F.col("_path")

    breakdown = (F.when(p == "detail", F.coalesce(F.col("_kw_dim"), F.lit("sub_category")))
                  .when(p.isin("yoy_general", "mom"), F.lit(None))
                  .when(F.col("intent").isin("kpi_value", "kpi_trend", "kpi_rank", "kpi_compare"), dim))
    mentioned = {d: F.coalesce(F.col(f"m_{d}"), F.array().cast("array<string>")) for d in VALUE_DIMS}
    inject = None
    for d in VALUE_DIMS:
        inject = F.when(F.size(mentioned[d]) > 0, F.lit(d)) if inject is None else \
            inject.when(F.size(mentioned[d]) > 0, F.lit(d))
    breakdown = F.coalesce(breakdown, F.when(F.col("intent").isin("kpi_value", "kpi_trend"), inject))

    grain = (F.when(p.isin("yoy_general", "yoy"), F.lit("year")).when(p == "mom", F.lit("month"))
              .when(F.col("intent") == "kpi_trend", F.col("_grain")))
    compare_period = F.when(F.col("intent") == "kpi_compare", cmp)
    top_k = (F.when(p == "detail", F.lit(15)).when(p == "growth", F.coalesce(F.col("_top"), F.lit(10)))
              .when(F.col("intent") == "kpi_rank", F.col("_top")))
    out_metrics = (F.when(p == "detail", F.array(F.lit("sales"), F.lit("profit")))
                    .when(p == "growth", F.array(F.lit("sales")))
                    .when(p.isin("yoy_general", "yoy", "mom") | (F.col("intent") == "kpi_compare"),
                          F.slice("metrics", 1, 1))
                    .otherwise(F.col("metrics")))
    window = (F.when(p == "detail", F.col("_explicit"))
               .when((p == "growth") & ~has_dates, relative_window(F.lit("past 30 days"), F.col("_hi")))
               .otherwise(dates))

    hint = (F.col("q").rlike(BREAKDOWN_PHRASE) | ql.rlike(TIME_YEAR) | ql.rlike(TIME_YM)
            | ql.rlike(TIME_GRAIN) | ql.rlike(TIME_REL) | ql.rlike(NUMERIC_DATE))
    fast = (F.when(F.col("is_loss") | (ql == "") | hint, F.lit(None))
             .when(ql.rlike(FAST_SUMMARY), "summary").when(ql.rlike(FAST_SALES), "total_sales")
             .when(ql.rlike(FAST_PROFIT), "total_profit").when(ql.rlike(FAST_ORDERS), "total_orders")
             .when(ql.rlike(FAST_MARGIN), "margin"))

    return t.select(
        "id", F.col("q").alias("text"), "intent",
        F.when(F.col("intent").isNotNull(), out_metrics).alias("metrics"),
        F.when(F.col("intent").isNotNull(), breakdown).alias("breakdown"),
        grain.alias("time_grain"), compare_period.alias("compare_period"), top_k.alias("top_k"),
        F.coalesce(window["start"], bounds["lo"]).alias("start_date"),
        F.coalesce(window["end"], F.col("_hi")).alias("end_date"),
        "is_loss", "is_extremes", "is_growth_rank",
        *[mentioned[d].alias(f"mentioned_{d}") for d in VALUE_DIMS],
        fast.alias("fast_kpi"))
