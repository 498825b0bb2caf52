"""Stored KPI sums kept current by deliveries of order lines (S7), with exact distinct orders that merge.

A :class:`KpiStore` holds, for each dimension value and month, the sums of the
metrics and the set of its orders as bitmaps; every dashboard read is an
aggregate of those few rows.  ``deliver`` brings it up to date:

* new lines, also late ones of past months: the delivery alone is aggregated;
  sums are added, bitmaps are united;
* replaced days (their lines come again, whole): what was delivered for them
  before no longer counts; only the months they lie in are aggregated anew,
  from the stored lines of those months.

Distinct orders.  Sets of orders merge, counts do not.  Every order gets a
number once, densely and by its first day, so the orders of a month lie in few
*buckets* of 32768 numbers, and a set is one bitmap (4 KB) for each bucket it
touches.  A quarter, a year or all of time is the union of its months'
bitmaps: ``orders`` is exact for each.

Nothing is changed in place: a delivery adds folders of its own for lines,
replaced days and numbers, and writes the next version of the cells whole (it
is as large as months x values).  Readers see the newest version whose write
is complete; a delivery that failed leaves the last one as it was and can be
made again.

Null order ids count as no order, lines without a date belong to no month
(``month`` null), null values of a dimension are a value of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.functions.metrics import DIMENSIONS, METRICS, ratio_pct
from kpiforge.sources.order_lines import MONEY
from kpiforge.sources.tables import newest_version, shared_table

TOTAL = "total"
GRAINS = ("month", "quarter", "year", "all")
WORDS = 512  # of 64 orders each, in a bitmap
NO_ORDER = 64  # parts that lines without an order are dealt to
_CELL = ["dimension", "value", "month", "bucket"]
_TYPES = {"sales": "decimal(38,2)", "profit": "decimal(38,4)", "lines": "bigint"}


def order_numbers(orders: DataFrame, start: int = 0, parts: int | None = None) -> DataFrame:
    """``order_id, number``: distinct ids of ``orders(order_id, order_date)`` numbered densely from ``start + 1``, by first day.

    Ids are dealt by range of (first day, id); a range's first number follows
    from the counts of the ranges before it, one row a range.
    """
    spark = orders.sparkSession
    ids = orders.where("order_id IS NOT NULL").groupBy("order_id").agg(F.min("order_date").alias("day"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(ids.repartitionByRange(n, "day", "order_id").withColumn("part", F.spark_partition_id()), "order-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("day", "order_id")
    return dealt.withColumn("k", F.row_number().over(within)).join(first, "part").select(
        "order_id", (F.col("first") + F.col("k") + start).cast("long").alias("number"))


def _bitmaps(batches):
    """Bitmaps of 32768 orders from their words of 64 (column 7: structs of a word's place and its bits)."""
    for batch in batches:
        words, cells = batch.column(7), batch.num_rows
        place, bits = words.flatten().flatten()
        of = np.repeat(np.arange(cells), np.asarray(words.value_lengths()))
        table = np.zeros((cells, WORDS), "<i8")
        table[of, np.asarray(place)] = np.asarray(bits)
        ends = pa.array(np.arange(cells + 1, dtype=np.int32) * (8 * WORDS))
        orders = pa.Array.from_buffers(pa.binary(), cells, [None, ends.buffers()[1], pa.py_buffer(table.tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], orders], [*batch.schema.names[:7], "orders"])


def order_cells(lines: DataFrame, numbers: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """Sums and order bitmaps of lines by dimension value, month and bucket of order numbers.

    Lines are dealt by bucket before they become one row for each dimension, so
    all of a cell lies in one task: the orders of 64 numbers are or-ed into one
    word there, and words, not lines, are put together as bitmaps.  Lines
    without an order have no bits; they are dealt to ``NO_ORDER`` parts, and a
    cell of theirs (``bucket`` null) is one row for each.
    """
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    sets = F.array(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(None).cast("string").alias("value")), *named)
    spread = -1 - F.pmod(F.xxhash64("month", "sales", "profit", *dims), F.lit(NO_ORDER))
    bit = F.bitmap_bit_position("number")
    rows = lines.join(numbers, "order_id", "left").select(
        "month", "sales", "profit", *dims, F.coalesce(F.bitmap_bucket_number("number"), spread).alias("bucket"),
        F.shiftright(bit, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bits"))
    rows = rows.repartition("bucket").select("month", "bucket", "word", "bits", "sales", "profit", F.inline(sets))
    words = rows.groupBy(*_CELL, "word").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("lines"),
                                             F.bit_or("bits").alias("bits"))
    cells = words.groupBy(*_CELL).agg(*[F.sum(c).cast(t).alias(c) for c, t in _TYPES.items()],
                                      F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))).alias("words"))
    schema = ", ".join(f"{n} {t}" for n, t in cells.dtypes[:7])
    return cells.withColumn("bucket", F.when(F.col("bucket") > 0, F.col("bucket"))).mapInArrow(_bitmaps, f"{schema}, orders binary")


def merged(cells: DataFrame) -> DataFrame:
    """Cells of the same name united: sums added, bitmaps or-ed."""
    return cells.groupBy(*_CELL).agg(*[F.sum(c).cast(t).alias(c) for c, t in _TYPES.items()], F.bitmap_or_agg("orders").alias("orders"))


class KpiStore:
    """Folders below ``path`` (a shared folder): ``lines``, ``replaced``, ``numbers`` by batch, ``cells`` by version."""

    def __init__(self, spark: SparkSession, path: str, dims=DIMENSIONS):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), list(dims)

    @property
    def version(self) -> int:
        return newest_version(self.spark, f"{self.path}/cells")

    def _batches(self, name: str, upto: int, first: int = 0, schema: str | None = None) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (read.schema(schema) if schema else read).parquet(*[f"{self.path}/{name}/batch={k}" for k in range(first, upto + 1)])

    def _lines(self, upto: int, first: int = 0, kind: str | None = None) -> DataFrame:
        # a delivery without lines has no file that says what its columns are; the numbers' files say what an order id is
        kind = kind or dict(self._batches("numbers", upto).dtypes)["order_id"]
        dims = "".join(f", {d} string" for d in self.dims)
        return self._batches("lines", upto, first, f"order_id {kind}, order_date date, sales {MONEY['sales']}, profit {MONEY['profit']}{dims}, "
                                                   "batch int, month date")

    def lines(self, version: int | None = None) -> DataFrame:
        """The order lines that count: a replaced day's earlier deliveries do not."""
        version = self.version if version is None else version
        # the last batch that replaced a day, one row a day
        replaced = self._batches("replaced", version).groupBy("day").agg(F.max("batch").alias("since"))
        rows = self._lines(version)
        return rows.join(replaced, rows["order_date"] == replaced["day"], "left").where(
            "since IS NULL OR batch >= since").drop("day", "since", "batch")

    def deliver(self, lines: DataFrame, replaces: DataFrame | None = None) -> int:
        """Take in a delivery; ``replaces``: a table of days (column ``order_date``) whose lines this delivery holds whole.
        Returns the new version."""
        k = self.version + 1
        months = F.trunc(F.col("order_date"), "month").alias("month")
        own = lines.select("order_id", F.col("order_date").cast("date"), *[F.col(c).cast(MONEY[c]) for c in ("sales", "profit")],
                           *[F.col(d).cast("string") for d in self.dims], months)
        # a month gets files of useful size, not one from each task
        own.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/lines/batch={k}")
        days = self.spark.createDataFrame([], "day date") if replaces is None else replaces.select(F.col("order_date").alias("day")).distinct()
        days.where("day IS NOT NULL").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/replaced/batch={k}")
        # from here on the delivery is read as it was stored: what it was made from is not computed again
        own = self._lines(k, first=k, kind=dict(own.dtypes)["order_id"]).drop("batch")
        fresh, start = own, 0
        if k:
            known = self._batches("numbers", k - 1)
            start = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
            fresh = own.where("order_id IS NOT NULL").groupBy("order_id").agg(F.min("order_date").alias("order_date")).join(
                known.select("order_id"), "order_id", "left_anti")
        order_numbers(fresh, start).write.mode("overwrite").parquet(f"{self.path}/numbers/batch={k}")
        numbers = self._batches("numbers", k).select("order_id", "number")
        stale = self.spark.read.parquet(f"{self.path}/replaced/batch={k}").select(F.trunc("day", "month").alias("month")).distinct()
        cells = order_cells(own.join(stale, "month", "left_anti"), numbers, self.dims)
        if k:
            again = order_cells(self.lines(k).join(stale, "month", "left_semi"), numbers, self.dims)
            kept = self.spark.read.parquet(f"{self.path}/cells/version={k - 1}").join(stale, "month", "left_anti")
            cells = merged(kept.unionByName(cells).unionByName(again))
        else:
            cells = cells.unionByName(order_cells(own.join(stale, "month", "left_semi"), numbers, self.dims))
        cells.write.mode("overwrite").parquet(f"{self.path}/cells/version={k}")
        return k

    def breakdown(self, grain: str = "month", dims=None, metrics=METRICS) -> DataFrame:
        """``dimension, value, period`` and metrics from the newest version: every breakdown (and ``total``) for every period of
        ``grain`` (``all``: over all time, period null)."""
        if grain not in GRAINS:
            raise ValueError(f"expected a grain out of {', '.join(GRAINS)}; got {grain!r}")
        cells = self.spark.read.parquet(f"{self.path}/cells/version={self.version}")
        if dims is not None:
            cells = cells.where(F.col("dimension").isin(list(dims)))
        period = F.lit(None).cast("date") if grain == "all" else F.trunc("month", grain)
        united = cells.withColumn("period", period).groupBy("dimension", "value", "period", "bucket").agg(
            F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.bitmap_count(F.bitmap_or_agg("orders")).alias("orders"))
        s, p = F.sum("sales"), F.sum("profit")
        of = {"sales": s.cast("double"), "profit": p.cast("double"), "orders": F.sum("orders").cast("long"), "profit_margin": ratio_pct(p, s)}
        return united.groupBy("dimension", "value", "period").agg(*[of[m].alias(m) for m in metrics])
