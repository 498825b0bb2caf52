"""SQL table functions, stored layouts and live conversation windows."""

import contextlib
import glob
import io
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kpiforge.operators import compare, history, kpi
from kpiforge.sources import layout, sql_functions
from kpiforge.sources.order_lines import order_lines
from kpiforge.streaming import live_window


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ── SQL functions ──

def test_sql_functions_give_the_operators_rows(spark):
    lines = order_lines(spark, SF_SMALL)
    assert sql_functions.register_sql(spark, lines) == ["kpi_value", "kpi_by", "kpi_trend", "kpi_rank", "kpi_compare"]
    w = ("1997-01-01", "1998-06-30")
    dates = "DATE'1997-01-01', DATE'1998-06-30'"
    every = ["sales", "profit", "orders", "profit_margin"]
    assert rows(spark.sql(f"SELECT * FROM kpi_value({dates})")) == rows(kpi.kpi_value(lines, every, *w))
    assert rows(spark.sql("SELECT * FROM kpi_by('segment')")) == rows(kpi.kpi_value(lines, every, breakdown_by="segment"))
    assert rows(spark.sql(f"SELECT * FROM kpi_trend('quarter', {dates})")) == rows(kpi.kpi_trend(lines, every, "quarter", *w))
    assert rows(spark.sql(f"SELECT breakdown, value FROM kpi_rank('category', 'profit', 4, {dates}) ORDER BY position")) == rows(
        kpi.kpi_rank(lines, ["profit"], "category", 4, *w))
    for period in ("prev_period", "mom", "yoy"):
        assert rows(spark.sql(f"SELECT * FROM kpi_compare('sales', 'region', {dates}, '{period}')")) == rows(
            compare.kpi_compare(lines, "sales", *w, period, "region").select("breakdown", "current", "previous", "change_pct"))


def test_sql_functions_prune_and_push_down(spark):
    sql_functions.register_sql(spark, order_lines(spark, SF_SMALL))
    p = plan(spark.sql("SELECT breakdown, sales FROM kpi_by('region', DATE'1997-01-01')"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_order", p)
    assert "p_type" not in p and "c_mktsegment" not in p and "l_discount" not in p


@pytest.mark.parametrize("call", ["kpi_by('colour')", "kpi_trend('day')", "kpi_rank('region', 'tax', 3)",
                                  "kpi_compare('sales', 'region', DATE'1997-01-01', DATE'1997-02-01', 'wow')"])
def test_sql_functions_reject_unknown_names(spark, call):
    sql_functions.register_sql(spark, order_lines(spark, SF_SMALL))
    with pytest.raises(Exception, match="expected one of"):
        spark.sql(f"SELECT * FROM {call}").collect()


# ── layouts ──

def test_co_located_join_moves_no_lines(spark, tmp_path):
    lines = order_lines(spark, SF_SMALL)
    layout.store_by_order(spark, SF_SMALL, str(tmp_path), "colocated", buckets=4)
    stored = layout.lines_by_order(spark, SF_SMALL, "colocated")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no side were small
    try:
        p, moved = plan(stored.select("order_id", "sales", "region")), plan(lines.select("order_id", "sales", "region"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"Exchange hashpartitioning\((l|o)_orderkey", p)
    assert re.search(r"Exchange hashpartitioning\(l_orderkey", moved)
    assert rows(stored) == rows(lines)
    assert rows(kpi.kpi_value(stored, ["profit", "orders"], breakdown_by="region")) == rows(
        kpi.kpi_value(lines, ["profit", "orders"], breakdown_by="region"))


def test_buckets_follow_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "LINES_PER_TASK", 500)
    tables = layout.store_by_order(spark, SF_SMALL, str(tmp_path), "by_size")
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    for t in tables:
        assert len(glob.glob(f"{tmp_path}/{t}/*.parquet")) == -(-n // 500) > layout.MIN_BUCKETS
    assert rows(layout.lines_by_order(spark, SF_SMALL, "by_size")) == rows(order_lines(spark, SF_SMALL))


def test_clustering_moves_no_lines_to_their_dimension(spark, make_lines):
    """Even where Spark does not know that the values are few."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(layout.z_order(make_lines([])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert p.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in p


def groups_read(path, low, high, region):
    """Row groups whose statistics allow a row of the filter, and all."""
    read = total = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(k).name for k in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            d, r = (meta.row_group(g).column(names.index(c)).statistics for c in ("order_date", "region"))
            total += 1
            read += str(d.max) >= low and str(d.min) <= high and r.min <= region <= r.max
    return read, total


def test_clustering_skips_row_groups(spark, tmp_path):
    lines = order_lines(spark, SF_SMALL)
    lines.repartitionByRange(64, "order_date").sortWithinPartitions("order_date").write.parquet(str(tmp_path / "sorted"))
    layout.store_clustered(lines, str(tmp_path / "clustered"), files=64)
    a, n = groups_read(tmp_path / "sorted", "1996-01-01", "1997-12-31", "ASIA")
    b, m = groups_read(tmp_path / "clustered", "1996-01-01", "1997-12-31", "ASIA")
    assert n >= 50 and m >= 50 and b <= 0.6 * a
    a, _ = groups_read(tmp_path / "sorted", "1900-01-01", "2100-01-01", "EUROPE")  # a filter on the region alone
    b, _ = groups_read(tmp_path / "clustered", "1900-01-01", "2100-01-01", "EUROPE")
    assert a == n and b <= 0.6 * m
    assert rows(spark.read.parquet(str(tmp_path / "clustered"))) == rows(lines)


def test_interleaved_bits(spark):
    got = spark.range(16).select("id", layout.interleaved([F.shiftright("id", 2), F.col("id") % 4], 2).alias("z")).collect()
    for r in got:
        a, b = r["id"] >> 2, r["id"] & 3
        assert r["z"] == (a >> 1) << 3 | (b >> 1) << 2 | (a & 1) << 1 | (b & 1)


def test_clustered_nulls_and_no_rows(spark, make_lines, tmp_path):
    from conftest import line
    some = make_lines([line(1, None), line(2, "2020-01-05", region=None), line(3, "2021-01-05", category=None), line(4, "2020-06-01")])
    layout.store_clustered(some, str(tmp_path / "some"), files=3)
    assert rows(spark.read.parquet(str(tmp_path / "some"))) == rows(some)
    assert layout.z_order(make_lines([])).collect() == []


# ── live windows ──

def test_live_windows_after_each_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "conv_id long, turn long, role string, text string"
    messages = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "", "short", "long " * 60])) for c in range(6) for t in range(rng.choice([1, 5, 40]))]
    rng.shuffle(messages)
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    for k in range(2):
        part = messages[k::2]
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        live_window.start_windows(stream, out, state).awaitTermination()  # goes on from the checkpoint
        assert rows(live_window.current_windows(spark, out)) == rows(history.history_summary(spark.createDataFrame(seen, schema)).select(
            "conv_id", "kept_messages", "first_kept_turn", "summary"))
    old = [(c, -5, "user", "too old") for c, n in ((m[0], sum(x[0] == m[0] for x in messages)) for m in messages) if n >= 16][:1]
    spark.createDataFrame(old or [(99, 1, "user", "new")], schema).coalesce(1).write.mode("append").parquet(inbox)
    before = rows(live_window.current_windows(spark, out))
    live_window.start_windows(spark.readStream.schema(schema).parquet(inbox), out, state).awaitTermination()
    assert rows(live_window.current_windows(spark, out)) == before or not old
    with pytest.raises(FileNotFoundError):
        live_window.current_windows(spark, str(tmp_path / "nothing"))
