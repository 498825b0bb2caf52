"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Builds the wide ``order_lines`` table from the star schema once (timed as
``materialize``), writes it partitioned by order year under the session's
checkpoint folder, then runs the headline queries over it and the text
queries over the driver's text tables.  Each query is executed completely
(``write.format("noop")``) without bringing rows to the driver.  One tiny
untimed job starts the session first.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiforge.operators import compare, dashboard, detail, facts, history, kpi, retrieval  # noqa: E402
from kpiforge.session import checkpoint_dir, get_session  # noqa: E402
from kpiforge.sources.order_lines import materialize_order_lines, order_lines  # noqa: E402
from kpiforge.sources.tables import read_table  # noqa: E402


def run(result) -> None:
    for df in (result.values() if isinstance(result, dict) else [result]):
        df.write.format("noop").mode("overwrite").save()
    if isinstance(result, dict) and "shared" in result:
        result["shared"].unpersist()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", 2 * cpus)), app_name="kpiforge-bench")
    wide_path = f"{checkpoint_dir(spark)}/order_lines-{uuid.uuid4().hex[:8]}"

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    # untimed: start the executors' JVM threads and code paths once
    spark.range(1000).selectExpr("sum(id)").collect()
    timed("materialize", lambda: materialize_order_lines(order_lines(spark, sf_dir, partitions=cpus), wide_path))
    ol = spark.read.parquet(wide_path)

    headline = {
        "by_region": lambda: kpi.kpi_value(ol, ["profit", "orders"], breakdown_by="region"),
        "trend_month_by_segment": lambda: kpi.kpi_trend(ol, ["sales"], "month", breakdown_by="segment"),
        "compare_yoy_by_sub_category": lambda: compare.kpi_compare(
            ol, "profit", "2000-01-01", "2000-12-31", "yoy", breakdown_by="sub_category"),
        "detail_loss_groups": lambda: detail.detail_summary(ol, "sub_category"),
        "detail_loss_rows": lambda: detail.detail_rows(ol, "sub_category"),
        "grouping_sets_all": lambda: kpi.breakdown_all(ol),
        "kpi_total": lambda: kpi.kpi_total(ol),
        "facts": lambda: facts.build_facts(ol),
        "dashboard_frames": lambda: dashboard.dashboard_frames(ol),
        "tfidf_topk": lambda: retrieval.retrieve(
            retrieval.fit_tfidf(read_table(spark, sf_dir, "documents", partitions=cpus), "doc_id", "text"),
            read_table(spark, sf_dir, "benchmark"), 10, "item_id", "text"),
        "history_window": lambda: history.history_summary(read_table(spark, sf_dir, "conversations")),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    for name, build in headline.items():
        if only and name not in only:
            continue
        timed(name, lambda b=build: run(b()))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).replace("sf", ""),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
