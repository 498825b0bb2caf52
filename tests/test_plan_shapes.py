"""Physical-plan properties the design relies on, read from ``explain()``."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kpiforge import catalog
from kpiforge.operators import detail, kpi, plan_batch
from kpiforge.sources.order_lines import (
    latest_order_date, latest_wide_date, line_tasks, materialize_order_lines, order_lines, order_lines_by_order)
from kpiforge.sources.tables import extent


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def scans(text: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", text))


def test_compare_is_one_scan_with_pushed_windows(spark):
    p = plan(catalog.QUERIES["compare_yoy_by_region"](spark, SF_SMALL))
    assert scans(p, "lineitem") == 1 and scans(p, "orders") == 1
    assert re.search(r"PushedFilters: \[Or\(And\(GreaterThanOrEqual\(o_orderdate", p)


def test_grouping_sets_one_scan(spark):
    p = plan(catalog.QUERIES["grouping_sets_all"](spark, SF_SMALL))
    assert scans(p, "lineitem") == 1 and "Window" not in p
    # lines are dealt by order once, then summed and counted where they lie: above that only sums of values move
    moved = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", p)
    assert [m for m in moved if "order_id" in m][0].count(",") == 0 and len([m for m in moved if "order_id" in m]) == 1
    assert "Expand" in plan(kpi.breakdown_all(order_lines(spark, SF_SMALL), approx_orders=True))


def test_topk_plans(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["rank_sub_category"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["preview_100"](spark, SF_SMALL))
    t = plan(catalog.QUERIES["tfidf_topk"](spark, SF_SMALL))
    assert re.search(r"WindowGroupLimit .*Partial", t)
    h = plan(catalog.QUERIES["history_window"](spark, SF_SMALL))
    # read from the top: the final limit, the exchange by conversation, and below it the limit of every task
    assert re.search(r"WindowGroupLimit[^\n]*Final.*Exchange hashpartitioning\(conv_id[^\n]*.*WindowGroupLimit[^\n]*Partial", h, re.S)


def test_no_repartition_by_key_under_the_scan(spark):
    for name in ("by_region", "history_window", "followup_query"):
        assert "REPARTITION" not in plan(catalog.QUERIES[name](spark, SF_SMALL)), name


def test_one_tokenising_branch(spark):
    """Scoring reads the stored terms; documents are tokenised when the index is written and not again."""
    t = plan(catalog.QUERIES["tfidf_topk"](spark, SF_SMALL))
    assert scans(t, "documents") == 0


def test_heatmap_plans_without_a_job_and_in_one_pass(spark):
    for name in ("heatmap", "heatmap_cells", "discount_buckets"):
        assert scans(plan(catalog.QUERIES[name](spark, SF_SMALL)), "lineitem") == 1, name


def test_no_python_udf_anywhere(spark):
    for name in ("facts", "question_tags", "tfidf_pinned", "clean_numeric"):
        p = plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_year_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "wide")
    materialize_order_lines(order_lines(spark, SF_SMALL), path)
    wide = spark.read.parquet(path)
    p = plan(kpi.kpi_value(wide, ["sales"], "1998-01-01", "1998-03-31"))
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", p)
    assert kpi.kpi_value(wide, ["sales"], "1998-01-01", "1998-03-31").collect() == \
        kpi.kpi_value(order_lines(spark, SF_SMALL), ["sales"], "1998-01-01", "1998-03-31").collect()


def test_windows_up_to_the_latest_date_scan_the_lines_once(spark):
    for name in ("relative_30d", "relative_6w", "relative_5m", "relative_2y", "current_quarter", "current_periods", "rank_recent"):
        p = plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert scans(p, "lineitem") == 1 and scans(p, "orders") == 1, name
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_order", p), name  # the window is a literal


def test_latest_date_from_footers(spark, tmp_path):
    path = str(tmp_path / "wide")
    lines = order_lines(spark, SF_SMALL)
    materialize_order_lines(lines, path)
    assert "PushedAggregation: [MIN(order_date), MAX(order_date)]" in plan(extent(spark, path, "order_date"))
    want = lines.agg(F.max("order_date")).first()[0]
    assert latest_wide_date(spark, path) == latest_order_date(spark, SF_SMALL) == want
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # settings of the session are as they were


def test_latest_date_is_that_of_a_line(spark, tmp_path):
    """The latest orders have no lines; then no order has."""
    for t in ("lineitem", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    late = orders.limit(3).withColumn("o_orderkey", -F.col("o_orderkey") - 1).withColumn("o_orderdate", F.lit("2030-01-01").cast("timestamp"))
    orders.unionByName(late).write.parquet(f"{tmp_path}/orders.parquet")
    assert latest_order_date(spark, str(tmp_path)) == latest_order_date(spark, SF_SMALL)
    orders.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert latest_order_date(spark, str(tmp_path)) is None


def unhinted(spark, make):
    """The plan of ``make()`` as if no side of a join were small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return plan(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setitem(line_tasks.__globals__, "LINES_PER_TASK", 100)
    few = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert line_tasks(spark, SF_SMALL) == -(-few // 100) > 40
    monkeypatch.setitem(line_tasks.__globals__, "LINES_PER_TASK", 10 * few)
    assert line_tasks(spark, SF_SMALL) is None


def test_lines_dealt_by_order_are_not_moved_to_be_counted(spark):
    def moves(p):
        return [m for m in re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", p) if "order" in m]

    dealt = order_lines_by_order(spark, SF_SMALL, 9)
    cube = plan_batch._per_order_day
    for make in (lambda: kpi.breakdown_all(dealt, tasks=9), lambda: detail.detail_summary(dealt, top_k=None), lambda: cube(dealt, ["region", "state"], 9)):
        assert sorted(m.split("#")[0] for m in moves(unhinted(spark, make))) == ["l_orderkey", "o_orderkey"]
    plain = order_lines(spark, SF_SMALL)
    for a, b in ((dealt, plain), (kpi.breakdown_all(dealt, tasks=9), kpi.breakdown_all(plain)), (detail.detail_summary(dealt), detail.detail_summary(plain))):
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
