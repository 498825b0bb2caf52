"""Streaming refresh: a stream over order-line files gives the batch numbers."""

from conftest import SF_SMALL
from kpiforge.operators import kpi
from kpiforge.sources.order_lines import order_lines
from kpiforge.streaming.refresh import latest_refresh, start_refresh


def test_stream_matches_batch(spark, tmp_path):
    base = str(tmp_path)
    ol = order_lines(spark, SF_SMALL)
    ol.write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema(ol.schema).parquet(f"{base}/in")
    q = start_refresh(stream, f"{base}/out", f"{base}/ckpt", grain="year", dims=("region",))
    q.awaitTermination(300)
    got = {(r["period"], r["region"]): (r["sales"], r["lines"])
           for r in latest_refresh(spark, f"{base}/out").collect()}
    want = kpi.kpi_trend(ol, ["sales"], "year", breakdown_by="region").collect()
    assert {(r["period"], r["breakdown"]): r["sales"] for r in want} == {k: v[0] for k, v in got.items()}
    assert sum(v[1] for v in got.values()) == ol.count()


def test_refreshed_query_reads_its_lines_in_many_tasks_and_three_batches(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from conftest import SF_SMALL
    from kpiforge import catalog

    monkeypatch.setattr(catalog, "shared_path", lambda spark, name: str(tmp_path / name))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        catalog.QUERIES["refreshed_by_month"](spark, SF_SMALL).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(list(Path(tmp_path / "lines-in").glob("part-*.parquet"))) == 12
    assert len(list(Path(tmp_path / "refresh").glob("epoch=*"))) == 3
