"""A batch of plans gives every plan the rows that its own operator gives it."""

import random
from datetime import date, timedelta

import pytest

from conftest import SF_SMALL, line
from kpiforge import catalog
from kpiforge.operators import compare, kpi, plan_batch
from kpiforge.sources.order_lines import order_lines

SCHEMA = ("plan_id string, intent string, metric string, breakdown_by string, start_date date, end_date date, compare_period string, "
          "time_grain string, top_k int, note string")


def alone(df, p):
    """The single operator's rows as (period, breakdown, current, previous, change_pct)."""
    by, s, e, m = p.get("breakdown_by"), p.get("start_date"), p.get("end_date"), p["metric"]
    if p["intent"] == "kpi_value":
        rows = kpi.kpi_value(df, [m], s, e, by).collect()
        return [(None, r["breakdown"] if by else None, r[m], None, None) for r in rows]
    if p["intent"] == "kpi_rank":
        return [(None, r["breakdown"], r[m], None, None) for r in kpi.kpi_rank(df, [m], by, p["top_k"], s, e).collect()]
    if p["intent"] == "kpi_trend":
        rows = kpi.kpi_trend(df.where("order_date IS NOT NULL"), [m], p["time_grain"], s, e, by).collect()
        return [(r["period"], r["breakdown"] if by else None, r[m], None, None) for r in rows]
    rows = compare.kpi_compare(df, m, s, e, p["compare_period"], by).collect()
    return [(None, r["breakdown"] if by else None, r["current"], r["previous"], r["change_pct"]) for r in rows]


def check(spark, df, plans):
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    got = {}
    for r in plan_batch.answer_plans(df, spark.createDataFrame([tuple(p.get(k) for k in keys) for p in plans], SCHEMA)).collect():
        got.setdefault(r["plan_id"], []).append(r)
    for p in plans:
        rows = sorted(got.get(p["plan_id"], []), key=lambda r: r["position"])
        have = [(r["period"], r["breakdown"], r["current"], r["previous"], r["change_pct"]) for r in rows]
        want = [(a, b, None if c is None else float(c), d, e) for a, b, c, d, e in alone(df, p)]
        assert have == want, p
        assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))


def plans_of(rng, n, low, days):
    out = []
    for k in range(n):
        s = low + timedelta(days=rng.randint(-40, days))
        p = {"plan_id": f"p{k}", "intent": rng.choice(["kpi_value", "kpi_rank", "kpi_trend", "kpi_compare"]),
             "metric": rng.choice(["sales", "profit", "orders", "profit_margin"]), "breakdown_by": rng.choice([None, "region", "segment", "sub_category"]),
             "start_date": s, "end_date": s + timedelta(days=rng.choice([0, 3, 30, 400])), "compare_period": None, "time_grain": None, "top_k": None}
        if p["intent"] == "kpi_rank":
            p.update(top_k=rng.randint(1, 4), breakdown_by=p["breakdown_by"] or "region")
        if p["intent"] == "kpi_trend":
            p.update(time_grain=rng.choice(["week", "month", "quarter", "year"]))
        if p["intent"] == "kpi_compare":
            p.update(compare_period=rng.choice(["prev_period", "mom", "yoy"]))
        elif rng.random() < 0.3:
            p[rng.choice(["start_date", "end_date"])] = None
        out.append(p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_plans_on_lines_of_all_kinds(spark, make_lines, seed):
    """Orders on many days, orders without id or date, values and amounts that are null."""
    rng = random.Random(seed)
    low = date(2020, 1, 20)
    rows = []
    for _ in range(400):
        d = low + timedelta(days=int(rng.random() ** 2 * 500)) if rng.random() < 0.95 else None
        rows.append(line(rng.choice([None, *range(60)]), d, region=rng.choice(["EAST", "WEST", None]), segment=rng.choice(["A", "B", "C"]),
                         sub_category=rng.choice(["x", "y", "z", "w", "v"]), sales=rng.choice(["10.00", "0.00", "7.25", None]),
                         profit=rng.choice(["1.0000", "-3.5000", None])))
    plans = plans_of(rng, 24, low, 520)
    plans += [{"plan_id": "all", "intent": "kpi_value", "metric": "orders"}, {"plan_id": "all2", "intent": "kpi_value", "metric": "sales", "breakdown_by": "region"},
              {"plan_id": "trend", "intent": "kpi_trend", "metric": "orders", "time_grain": "quarter"}]
    check(spark, make_lines(rows), plans)


def test_no_lines_and_plans_with_a_problem(spark, make_lines):
    plans = [{"plan_id": "v", "intent": "kpi_value", "metric": "sales", "start_date": date(2020, 1, 1), "end_date": date(2020, 1, 2)},
             {"plan_id": "c", "intent": "kpi_compare", "metric": "profit", "start_date": date(2020, 1, 1), "end_date": date(2020, 1, 2), "compare_period": "mom"},
             {"plan_id": "t", "intent": "kpi_trend", "metric": "profit", "time_grain": "week"}]
    check(spark, make_lines([]), plans)
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    bad = [{"plan_id": "1", "intent": "guess", "metric": "sales"}, {"plan_id": "2", "intent": "kpi_value", "metric": "tax"},
           {"plan_id": "3", "intent": "kpi_rank", "metric": "sales", "breakdown_by": "region"},
           {"plan_id": "4", "intent": "kpi_rank", "metric": "sales", "top_k": 3},
           {"plan_id": "5", "intent": "kpi_trend", "metric": "sales"}, {"plan_id": "6", "intent": "kpi_compare", "metric": "sales", "compare_period": "yoy"},
           {"plan_id": "7", "intent": "kpi_value", "metric": "sales", "start_date": date(2020, 2, 1), "end_date": date(2020, 1, 1)},
           {"plan_id": "8", "intent": "kpi_value", "metric": "sales", "breakdown_by": "colour"}]
    df = spark.createDataFrame([tuple(p.get(k) for k in keys) for p in bad], SCHEMA)
    assert {r["plan_id"]: r["problem"] for r in plan_batch.check_plans(df).collect()} == {
        "1": "intent", "2": "metric", "3": "top_k", "4": "breakdown_by", "5": "time_grain", "6": "start_date", "7": "end_date", "8": "breakdown_by"}
    assert plan_batch.answer_plans(make_lines([]), df).collect() == []


def test_given_lines(spark):
    lines = order_lines(spark, SF_SMALL)
    plans = [r.asDict() for r in catalog.batch_of_plans(spark, SF_SMALL).where("plan_id LIKE '%199701' OR plan_id LIKE '%199212'").collect()]
    assert len(plans) in (5, 10)
    check(spark, lines, plans)
