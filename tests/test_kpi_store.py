"""A KPI store after any deliveries equals the aggregate of the lines that count."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import line
from kpiforge.operators.kpi_store import KpiStore, order_cells, order_numbers

LOW = date(2021, 1, 5)


def some_lines(rng, n, days, orders=400):
    return [line(rng.choice([None, *range(orders)]), LOW + timedelta(days=rng.choice(days)) if rng.random() < 0.97 else None,
                 region=rng.choice(["EAST", "WEST", None]), segment=rng.choice(["A", "B"]), state=rng.choice(["NY", "LA"]),
                 sub_category=rng.choice(["x", "y", "z"]), sales=rng.choice(["10.00", "3.35", None]), profit=rng.choice(["1.2500", "-2.0000"]))
            for _ in range(n)]


def expected(df, grain):
    period = F.lit(None).cast("date") if grain == "all" else F.trunc("order_date", grain)
    out = []
    for d in ["total", "region", "segment", "category", "sub_category", "state"]:
        value = F.lit(None).cast("string") if d == "total" else F.col(d)
        rows = df.groupBy(value.alias("value"), period.alias("period")).agg(
            F.sum("sales").cast("double"), F.sum("profit").cast("double"), F.count_distinct("order_id")).collect()
        out += [(d, *r) for r in rows]
    return sorted(out, key=repr)


def check(store, df, grains=("month", "quarter", "all")):
    for grain in grains:
        got = store.breakdown(grain, metrics=["sales", "profit", "orders"]).select("dimension", "value", "period", "sales", "profit", "orders")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(df, grain), grain


def test_new_late_and_replaced_lines(spark, make_lines, tmp_path):
    rng = random.Random(5)
    store = KpiStore(spark, str(tmp_path / "store"))
    assert store.version == -1
    first = some_lines(rng, 300, range(100))
    assert store.deliver(make_lines(first)) == 0
    check(store, make_lines(first))
    late = some_lines(rng, 120, range(60, 200), 900)  # new months, late lines of old ones, known and new orders
    assert store.deliver(make_lines(late)) == 1
    check(store, make_lines(first + late))
    gone = [LOW + timedelta(days=k) for k in (10, 11, 70, 500)]  # one of them has no lines yet
    again = some_lines(rng, 40, [10, 70], 900)
    kept = [r for r in first + late if r[1] not in gone]
    again = [r for r in again if r[1] is not None] + some_lines(rng, 30, range(150, 160))
    assert store.deliver(make_lines(again), spark.createDataFrame([(d,) for d in gone], "order_date date")) == 2
    check(store, make_lines(kept + again), ("month", "quarter", "year", "all"))
    assert sorted(map(repr, store.lines().select("order_id", "order_date", "sales").collect())) == sorted(
        map(repr, make_lines(kept + again).select("order_id", "order_date", "sales").collect()))
    twice = some_lines(rng, 20, [10])  # a day replaced again
    kept = [r for r in kept + again if r[1] != gone[0]]
    store.deliver(make_lines([r for r in twice if r[1] is not None]), spark.createDataFrame([(gone[0],)], "order_date date"))
    check(store, make_lines(kept + [r for r in twice if r[1] is not None]))
    with pytest.raises(ValueError):
        store.breakdown("week")


def test_a_failed_delivery_leaves_the_store_as_it_was(spark, make_lines, tmp_path):
    rng = random.Random(6)
    store = KpiStore(spark, str(tmp_path / "store"))
    first, second = some_lines(rng, 80, range(40)), some_lines(rng, 50, range(80))
    store.deliver(make_lines(first))
    bad = make_lines(second).withColumn("sales", F.expr("if(segment = 'A', CAST(raise_error('lost') AS decimal(12,2)), sales)"))
    with pytest.raises(Exception):
        store.deliver(bad)
    assert store.version == 0
    check(store, make_lines(first), ("month",))
    store.deliver(make_lines(second))
    check(store, make_lines(first + second), ("month",))


def test_empty_deliveries(spark, make_lines, tmp_path):
    store = KpiStore(spark, str(tmp_path / "store"))
    store.deliver(make_lines([]))
    assert store.breakdown("all").collect() == []
    rows = some_lines(random.Random(1), 30, range(30))
    store.deliver(make_lines(rows))
    store.deliver(make_lines([]))
    check(store, make_lines(rows), ("month",))


def test_numbers_are_dense_and_by_day(spark, make_lines):
    rows = [line(k * 1000003, LOW + timedelta(days=(k * 37) % 90)) for k in range(70000 // 100)] + [line(None, LOW)]
    got = {r["order_id"]: r["number"] for r in order_numbers(make_lines(rows), 5, parts=7).collect()}
    want = sorted((r[1], r[0]) for r in rows if r[0] is not None)
    assert got == {o: 6 + k for k, (_, o) in enumerate(want)}


def test_orders_beyond_one_bucket(spark):
    lines = spark.range(100000).select(F.col("id").alias("order_id"), F.lit(LOW).alias("order_date"), F.trunc(F.lit(LOW), "month").alias("month"),
                                       F.lit(1).cast("decimal(12,2)").alias("sales"), F.lit(1).cast("decimal(18,4)").alias("profit"), F.lit("v").alias("region"))
    cells = order_cells(lines.unionByName(lines), order_numbers(lines), ["region"])
    assert {(r["dimension"], r["n"], r["k"]) for r in cells.groupBy("dimension").agg(
        F.sum(F.bitmap_count("orders")).alias("n"), F.count("*").alias("k")).collect()} == {("total", 100000, 4), ("region", 100000, 4)}


def test_cells_are_made_from_words_of_orders(spark, make_lines):
    """Bitmaps are those of Spark's own aggregate; lines without an order count in sums alone."""
    rng = random.Random(8)
    lines = make_lines(some_lines(rng, 500, range(50), 90000)).withColumn("month", F.trunc("order_date", "month"))
    numbers = lines.where("order_id IS NOT NULL").select("order_id", (F.col("order_id") + 1).alias("number")).distinct()
    cells = order_cells(lines, numbers, ["region", "state"])
    text = cells._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" not in text and "SortAggregate" not in text  # lines are hashed, not sorted
    got = cells.groupBy("dimension", "value", "month", "bucket").agg(
        F.sum("sales").cast("double"), F.sum("profit").cast("double"), F.sum("lines"), F.bitmap_or_agg("orders")).collect()
    want = []
    for d in ("total", "region", "state"):
        value = F.lit(None).cast("string") if d == "total" else F.col(d)
        want += lines.join(numbers, "order_id", "left").groupBy(F.lit(d), value, "month", F.bitmap_bucket_number("number")).agg(
            F.sum("sales").cast("double"), F.sum("profit").cast("double"), F.count("*"), F.bitmap_construct_agg(F.bitmap_bit_position("number"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_a_month_is_a_few_files_whatever_the_tasks(spark, make_lines, tmp_path):
    lines = make_lines(some_lines(random.Random(9), 400, range(25))).repartition(32)
    KpiStore(spark, str(tmp_path / "store")).deliver(lines)
    files = list((tmp_path / "store" / "lines").rglob("*.parquet"))
    assert files and len(files) <= 8


def test_a_delivery_is_computed_once(spark, make_lines, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = make_lines(some_lines(random.Random(10), 50, range(25)))
    store = KpiStore(spark, str(tmp_path / "store"))
    for k in (1, 2):
        store.deliver(lines.mapInArrow(watched, lines.schema))
        assert seen.value == 50 * k
