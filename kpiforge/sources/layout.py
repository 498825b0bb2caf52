"""Layouts of stored order lines: co-located by order (S3), clustered by date and dimensions.

:func:`store_by_order` writes lines and orders as tables bucketed and sorted by
the order key; the star join of both then moves no line to its order, however
large they are, and sorts nothing but (sorted) buckets in their task
(:func:`lines_by_order`).

:func:`store_clustered` orders a wide table along a Z-curve: the bits of the
date's and the dimensions' codes interleave, so a file or row group spans a
narrow range of each, and a filter on any of them skips most (by min / max
statistics), not only one on the leading column of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.sources.order_lines import LINES_PER_TASK, order_side, wide_columns
from kpiforge.sources.tables import read_table

MIN_BUCKETS = 8


def store_by_order(spark: SparkSession, sf_dir: str, path: str, name: str, buckets: int | None = None) -> tuple[str, str]:
    """Write lines and orders (with their customers' attributes) below ``path`` as tables ``name_lines`` and ``name_orders``.
    A bucket is sorted, and later joined, by one task: unless ``buckets`` says how many, there is one for every ``LINES_PER_TASK``
    lines and ``MIN_BUCKETS`` at least, so a task holds no more of a larger table."""
    buckets = buckets or max(MIN_BUCKETS, -(-read_table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK))
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    made = f"{name}_lines", f"{name}_orders"
    for table, df, key in ((made[0], lines, "l_orderkey"), (made[1], order_side(spark, sf_dir), "o_orderkey")):
        # rows of a bucket meet before they are written: a file for each bucket, not for each task and bucket
        (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").saveAsTable(table))
    return made


def lines_by_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The order lines of :func:`kpiforge.sources.order_lines.order_lines` from the stored tables and ``part``."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    lines, orders = spark.table(f"{name}_lines"), spark.table(f"{name}_orders")
    return wide_columns(lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, F.col("l_partkey") == F.col("p_partkey")))


def interleaved(codes: list[Column], bits: int) -> Column:
    """One long whose bits are those of the codes (each below 2**bits) in turn, the first code's highest bit first."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in codes:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")))
    return out


def _scaled(rank: Column, count: Column, bits: int) -> Column:
    return F.floor(rank * (1 << bits) / F.greatest(count, F.lit(1))).cast("long")


def z_order(df: DataFrame, date: str = "order_date", dims=("region", "category"), bits: int = 8) -> DataFrame:
    """``df`` with a column ``z``: the date and each dimension's place among its distinct values, scaled to ``bits`` bits, interleaved."""
    low, high = df.agg(F.min(date)).scalar(), df.agg(F.max(date)).scalar()
    codes = [F.coalesce(_scaled(F.datediff(F.col(date), low), F.datediff(high, low) + 1, bits), F.lit(0))]
    for d in dims:
        # distinct values of a dimension: few, numbered by one window
        values = df.where(F.col(d).isNotNull()).select(F.col(d).alias(f"_v_{d}")).distinct()
        numbered = values.withColumn(f"_z_{d}", F.expr(f"row_number() OVER (ORDER BY _v_{d}) - 1")).withColumn(f"_n_{d}", F.expr("count(*) OVER ()"))
        # the values go to the rows: joined by exchange, all rows of a value would meet in one task
        df = df.join(F.broadcast(numbered), F.col(d) == F.col(f"_v_{d}"), "left")
        codes.append(F.coalesce(_scaled(F.col(f"_z_{d}"), F.col(f"_n_{d}"), bits), F.lit(0)))
    return df.withColumn("z", interleaved(codes, bits)).drop(*[f"_{k}_{d}" for k in "vzn" for d in dims])


def store_clustered(df: DataFrame, path: str, date: str = "order_date", dims=("region", "category"), bits: int = 8,
                    files: int | None = None, row_group_bytes: int | None = None) -> None:
    """Write ``df`` along the Z-curve of ``date`` and ``dims``, dealt to ``files`` files by range."""
    z = z_order(df, date, dims, bits)
    dealt = z.repartitionByRange(files, "z", date, *dims) if files else z.repartitionByRange("z", date, *dims)
    write = dealt.sortWithinPartitions("z", date, *dims).drop("z").write.mode("overwrite")
    if row_group_bytes:
        write = write.option("parquet.block.size", row_group_bytes)
    write.parquet(path)
