"""Analytic insights over KPI results.

All of these run on aggregated frames (periods x breakdown values, a few
thousand rows at most), never on raw order lines, so the windows below are
cheap even when a window has no partition key.  They return numbers and
class labels; turning them into sentences is presentation.

Trend windows are partitioned by ``breakdown`` when the frame has one (the
reference mixes breakdowns, D5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: class thresholds of the reference's rule insights
GROWTH_STRONG, GROWTH_MODERATE = 20, 5
CAGR_HEALTHY, CAGR_MODERATE = 10, 5
MOMENTUM_BAND, OUTLOOK_BAND = 10, 5
LEADER_GAP_UNEVEN = 40
TOP2_CONCENTRATED = 60
SWING_STRUCTURAL, SWING_NOTABLE, SWING_MEANINGFUL = 50, 30, 10
MARGIN_LOW, MARGIN_STRONG = 5, 20
MARGIN_HEALTHY, MARGIN_BENCHMARK = 10, 12


def _keys(df: DataFrame, key: str | None) -> list[str]:
    if key is None:
        key = "breakdown" if "breakdown" in df.columns else None
    return [key] if key else []


def growth_class(chg: Column) -> Column:
    """Strong (>=20), moderate (>=5), decline (<0), flat."""
    return (F.when(chg >= GROWTH_STRONG, "strong_growth")
             .when(chg >= GROWTH_MODERATE, "moderate_growth")
             .when(chg < 0, "decline").otherwise("flat"))


def period_changes(trend: DataFrame, metric: str, key: str | None = None) -> DataFrame:
    """W1 + W2: value of the prior period and change % per row.

    change_pct = (v - prev) / |prev| * 100, NULL for the first period and
    when prev is 0; growth_class treats a NULL change of a later period as flat.
    """
    keys = _keys(trend, key)
    w = Window.partitionBy(*keys).orderBy(F.col("period").asc())
    prev = F.lag(F.col(metric).cast("double")).over(w)
    rn = F.row_number().over(w)
    v = F.col(metric).cast("double")
    chg = F.when(prev != 0, (v - prev) / F.abs(prev) * 100)
    return (trend.withColumn("previous", prev).withColumn("change_pct", chg)
                 .withColumn("growth_class",
                             F.when(rn > 1, growth_class(F.coalesce(F.col("change_pct"), F.lit(0.0))))))


def trend_insights(trend: DataFrame, metric: str, grain: str | None = None,
                   key: str | None = None) -> DataFrame:
    """W3-W6 per breakdown value (or one row without a breakdown).

    n, first/last period and value, growth_pct (0 when first is 0), abs_change,
    cagr (year grain, 6 decimals; 0 when first <= 0, NULL when last < 0 (D21)) and its
    class, peak / trough (earliest period on ties), range, swing_pct (NULL
    when the peak is 0), momentum of the last 2 vs the 2 before (n >= 4) with
    class and outlook.  growth figures are NULL when n < 2.
    """
    keys = _keys(trend, key)
    v = F.col(metric).cast("double")
    base = trend.select(*keys, F.col("period"), v.alias("_v"))
    part = Window.partitionBy(*keys)
    base = (base
            .withColumn("_asc", F.row_number().over(part.orderBy(F.col("period").asc())))
            .withColumn("_desc", F.row_number().over(part.orderBy(F.col("period").desc())))
            .withColumn("_peak", F.row_number().over(part.orderBy(F.col("_v").desc(), F.col("period").asc())))
            .withColumn("_trough", F.row_number().over(part.orderBy(F.col("_v").asc_nulls_last(), F.col("period").asc()))))

    def at(flag: str, n: int, col: str = "_v") -> Column:
        return F.max(F.when(F.col(flag) == n, F.col(col)))

    agg = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        at("_asc", 1, "period").alias("first_period"), at("_asc", 1).alias("first_value"),
        at("_desc", 1, "period").alias("last_period"), at("_desc", 1).alias("last_value"),
        at("_peak", 1, "period").alias("peak_period"), at("_peak", 1).alias("peak_value"),
        at("_trough", 1, "period").alias("trough_period"), at("_trough", 1).alias("trough_value"),
        F.avg(F.when(F.col("_desc") <= 2, F.col("_v"))).alias("recent_avg"),
        F.avg(F.when(F.col("_desc").isin(3, 4), F.col("_v"))).alias("prior_avg"),
    )
    first, last, n = F.col("first_value"), F.col("last_value"), F.col("n")
    growth = F.when(n >= 2, F.when(first != 0, (last - first) / F.abs(first) * 100).otherwise(F.lit(0.0)))
    years = n - 1
    # rounded to 6 decimals: pow() may differ in the last bit between math libraries
    cagr = F.when(first > 0, F.when(last >= 0, F.round(
        (F.pow(last / first, F.try_divide(F.lit(1.0), years)) - 1) * 100, 6))).otherwise(F.lit(0.0))
    cagr = F.when((n >= 2) & F.lit(grain == "year"), cagr)
    rng = F.abs(F.col("peak_value") - F.col("trough_value"))
    prior, recent = F.col("prior_avg"), F.col("recent_avg")
    momentum = F.when((n >= 4) & (prior != 0), (recent - prior) / F.abs(prior) * 100)
    out = (agg.withColumn("growth_pct", growth)
              .withColumn("abs_change", F.when(n >= 2, F.abs(last - first)))
              .withColumn("direction", F.when(n >= 2, F.when(growth > 0, "grown").otherwise("declined")))
              .withColumn("cagr", cagr)
              .withColumn("cagr_class", F.when(F.col("cagr") >= CAGR_HEALTHY, "healthy")
                          .when(F.col("cagr") >= CAGR_MODERATE, "moderate")
                          .when(F.col("cagr").isNotNull(), "slow"))
              .withColumn("range", rng)
              .withColumn("swing_pct", F.when(F.col("peak_value") != 0, rng / F.abs(F.col("peak_value")) * 100))
              .withColumn("momentum_pct", momentum)
              .withColumn("momentum_class", F.when(momentum > MOMENTUM_BAND, "accelerating")
                          .when(momentum < -MOMENTUM_BAND, "decelerating")
                          .when(momentum.isNotNull(), "stable"))
              .withColumn("outlook", F.when(momentum > OUTLOOK_BAND, "continued_growth")
                          .when(momentum < -OUTLOOK_BAND, "slowdown")
                          .when(momentum.isNotNull(), "steady"))
              .withColumn("recent_avg", F.when(n >= 4, recent))
              .withColumn("prior_avg", F.when(n >= 4, prior)))
    return out.filter(n > 0)  # a global aggregate over no periods would give one empty row


def _exact_sum(col: Column) -> Column:
    """Sum of doubles that were exact decimals (<= 10 decimals), order independent."""
    return F.sum(col.cast("decimal(38,10)")).cast("double")


def rank_table(result: DataFrame, metric: str, key: str = "breakdown") -> DataFrame:
    """W7 + W12: rank (best first, ties by key) and share of the shown total.

    share_pct is 0 when the total is 0 and NULL for profit_margin (shares of
    ratios mean nothing, D19).
    """
    w_all = Window.partitionBy()
    total = F.sum(F.col(metric).cast("decimal(38,10)")).over(w_all).cast("double")
    v = F.col(metric).cast("double")
    share = F.lit(None).cast("double") if metric == "profit_margin" else \
        F.when(total != 0, v / total * 100).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), F.col(key).asc_nulls_last()))
    return result.select(rank.cast("long").alias("rank"), F.col(key).alias("breakdown"), v.alias("value"),
                         share.alias("share_pct"))


def rank_summary(result: DataFrame, metric: str, key: str = "breakdown") -> DataFrame:
    """W7-W11 in one row: leader and its share, gap to the runner-up (uneven > 40),
    top-2 concentration (n >= 3; concentrated >= 60), loss-making values and the
    worst of them (profit metrics), bottom entry (n >= 4)."""
    t = rank_table(result, metric, key)
    loss_metric = metric in ("profit", "profit_margin")
    agg = t.agg(
        F.count(F.lit(1)).alias("n"),
        _exact_sum(F.col("value")).alias("total"),
        F.max(F.when(F.col("rank") == 1, F.col("breakdown"))).alias("leader"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("leader_value"),
        F.max(F.when(F.col("rank") == 1, F.col("share_pct"))).alias("leader_share_pct"),
        F.max(F.when(F.col("rank") == 2, F.col("breakdown"))).alias("runner_up"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("runner_up_value"),
        _exact_sum(F.when(F.col("rank") <= 2, F.col("value"))).alias("_top2"),
        F.max_by(F.col("breakdown"), F.col("rank")).alias("bottom"),
        F.max_by(F.col("value"), F.col("rank")).alias("bottom_value"),
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.when(F.lit(loss_metric) & (F.col("value") < 0), F.struct("rank", "breakdown")))),
            lambda s: s["breakdown"]), ", ").alias("loss_values"),
        F.min(F.when(F.lit(loss_metric) & (F.col("value") < 0), F.col("value"))).alias("worst_loss"),
    )
    tv, sv, n = F.col("leader_value"), F.col("runner_up_value"), F.col("n")
    gap = F.when(n >= 2, F.when(tv != 0, F.abs(tv - sv) / F.abs(tv) * 100).otherwise(F.lit(0.0)))
    top2 = F.when((n >= 3) & (F.col("total") > 0), F.col("_top2") / F.col("total") * 100)
    return (agg.withColumn("leader_gap_pct", gap)
               .withColumn("uneven", gap > LEADER_GAP_UNEVEN)
               .withColumn("top2_pct", top2)
               .withColumn("concentrated", top2 >= TOP2_CONCENTRATED)
               .withColumn("loss_values", F.when(F.col("loss_values") != "", F.col("loss_values")))
               .withColumn("bottom", F.when(n >= 4, F.col("bottom")))
               .withColumn("bottom_value", F.when(n >= 4, F.col("bottom_value")))
               .drop("_top2").filter(n > 0))


def compare_insights(cmp: DataFrame) -> DataFrame:
    """W14 over a comparison row: direction, |change|, magnitude class, |delta|.

    Rows with previous = 0 get NULL insight columns (the reference says nothing).
    """
    cur, prev = F.col("current").cast("double"), F.col("previous").cast("double")
    chg = F.when(prev != 0, (cur - prev) / F.abs(prev) * 100)
    a = F.abs(chg)
    return (cmp.withColumn("direction", F.when(chg > 0, "increased").when(chg.isNotNull(), "decreased"))
               .withColumn("abs_change_pct", a)
               .withColumn("magnitude", F.when(a >= SWING_STRUCTURAL, "structural")
                           .when(a >= SWING_NOTABLE, "notable")
                           .when(a >= SWING_MEANINGFUL, "meaningful")
                           .when(a.isNotNull(), "modest"))
               .withColumn("abs_delta", F.when(chg.isNotNull(), F.abs(cur - prev))))


def value_insights(kpis: DataFrame, sales: str = "total_sales", profit: str = "total_profit",
                   orders: str = "total_orders") -> DataFrame:
    """W15 + W16 + A6 on a KPI row: margin and its classes, average order value."""
    s, p, o = F.col(sales).cast("double"), F.col(profit).cast("double"), F.col(orders).cast("double")
    margin = F.when(s != 0, p / s * 100).otherwise(F.lit(0.0))
    return (kpis.withColumn("margin_pct", margin)
                .withColumn("margin_class", F.when(margin < MARGIN_LOW, "low")
                            .when(margin > MARGIN_STRONG, "strong").otherwise("normal"))
                .withColumn("profit_health", F.when(margin >= MARGIN_HEALTHY, "healthy").otherwise("tight"))
                .withColumn("vs_benchmark", F.when(margin >= MARGIN_BENCHMARK, "above").otherwise("below"))
                .withColumn("avg_order_value", F.when(o != 0, s / o).otherwise(F.lit(0.0)))
                .withColumn("profitable", p > 0))


def last_periods_top(trend: DataFrame, metric: str, periods: int = 24, top: int = 5) -> DataFrame:
    """The last ``periods`` periods, then only the ``top`` breakdown values by
    summed metric over them (D7: periods, not rows)."""
    last = trend.select(F.col("period").alias("_p")).distinct().orderBy(F.col("_p").desc()).limit(periods)
    recent = trend.join(last, trend["period"].eqNullSafe(last["_p"]), "left_semi")
    if "breakdown" not in trend.columns:
        return recent.orderBy("period")
    best = (recent.groupBy("breakdown").agg(_exact_sum(F.col(metric).cast("double")).alias("_s"))
                  .orderBy(F.col("_s").desc(), F.col("breakdown").asc_nulls_last()).limit(top))
    t = best.select(F.col("breakdown").alias("_b"))
    return (recent.join(t, recent["breakdown"].eqNullSafe(t["_b"]), "left_semi")
                  .orderBy("period", "breakdown"))


def rank_insights(result: DataFrame, metric: str, key: str = "breakdown") -> tuple[DataFrame, DataFrame]:
    """W7-W12 for a ranked / broken-down result: ``(rank_table, rank_summary)``."""
    return rank_table(result, metric, key), rank_summary(result, metric, key)
