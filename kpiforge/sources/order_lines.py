"""The ``order_lines`` view: one row per order line.

Built from the star schema
``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part`` or read as one wide
table (parquet / JDBC).

Scale notes
-----------
* No join is hinted.  Spark broadcasts a side only when its planned size is
  under ``spark.sql.autoBroadcastJoinThreshold`` (nation and region always are;
  customer and part are at small scale) and falls back to a sort-merge join
  otherwise; AQE re-plans with runtime sizes and splits skewed partitions
  (a hot order key on the lineitem side).
* Filters on ``order_date`` / ``region`` / ... are pushed through the joins to
  the parquet scans of ``orders`` / ``region`` (checked with ``explain``).
* :func:`materialize_order_lines` writes the wide table partitioned by order
  year so that date filters prune whole directories.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from kpiforge.functions.numeric import clean_numeric
from kpiforge.sources.tables import extent, read_table

ORDER_LINES_COLUMNS = ("order_id", "order_date", "ship_date", "region", "state", "segment",
                       "category", "sub_category", "product_name", "sales", "discount", "profit")

MONEY = {"sales": "decimal(12,2)", "discount": "decimal(6,2)", "profit": "decimal(18,4)"}

FILTER_DIMS = ("region", "segment", "category", "sub_category", "state")


LINES_PER_TASK = 250_000  # of a table dealt by order: what a task holds does not grow with the table


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the lines dealt by order: one for every ``LINES_PER_TASK`` lines (counted in the files' footers), and no fewer than a
    shuffle has.  None where a task for each core holds no more than that: Spark chooses then."""
    tasks = -(-read_table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    return max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if tasks > spark.sparkContext.defaultParallelism else None


def order_lines(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Star schema -> wide order-line rows (mapping of SURVEY §1.3).

    ``partitions``: see :func:`kpiforge.sources.tables.read_table`; it applies to the line table.
    """
    li = read_table(spark, sf_dir, "lineitem", partitions).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                                 "p_retailprice")
    orders = order_side(spark, sf_dir)
    return wide_columns(li.join(orders, li.l_orderkey == orders.o_orderkey)
                          .join(p, li.l_partkey == p.p_partkey))


def order_lines_by_order(spark: SparkSession, sf_dir: str, tasks: int | None) -> DataFrame:
    """The rows of :func:`order_lines`, dealt by order to ``tasks`` tasks (:func:`line_tasks`; None: as Spark joins them).

    For queries of all lines that count orders: lines meet their parts first
    and their orders last, so an order's lines end in one task and are not
    moved again to be counted.  (With a filter on dates orders come first:
    they leave fewer lines.)
    """
    if tasks is None:
        return order_lines(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    of_line = _line_columns()
    priced = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", *[c.alias(n) for n, c in of_line.items()])
    orders = order_side(spark, sf_dir).repartition(tasks, "o_orderkey")
    joined = priced.repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = {**_order_columns(), **{n: F.col(n) for n in of_line}}
    return joined.select(*[columns[n].alias(n) for n in ORDER_LINES_COLUMNS])


def order_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' attributes.

    Dimensions first: orders get them in an orders-sized shuffle by custkey
    when customer is too big to broadcast, so the line-sized data is shuffled at
    most twice (by orderkey, by partkey).
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    cust = c.join(geo, c.c_nationkey == geo.n_nationkey)
    return o.join(cust, o.o_custkey == cust.c_custkey)


def _order_columns() -> dict[str, Column]:
    return {"order_id": F.col("o_orderkey"), "order_date": F.col("o_orderdate").cast("date"), "region": F.col("r_name"),
            "state": F.col("n_name"), "segment": F.col("c_mktsegment")}


def _line_columns() -> dict[str, Column]:
    sales = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    cost = F.col("l_quantity").cast("decimal(12,2)") * F.col("p_retailprice").cast("decimal(12,2)") * 2
    return {"ship_date": F.col("l_shipdate").cast("date"), "category": F.col("p_type"), "sub_category": F.col("p_brand"),
            "product_name": F.col("p_name"), "sales": sales, "discount": (disc * 5).cast("decimal(6,2)"),
            "profit": (sales * (1 - disc) - cost).cast("decimal(18,4)")}


def wide_columns(joined: DataFrame) -> DataFrame:
    """The order-line columns of joined lines, orders and parts."""
    columns = {**_order_columns(), **_line_columns()}
    return joined.select(*[columns[n].alias(n) for n in ORDER_LINES_COLUMNS])


def coerce_order_lines(df: DataFrame) -> DataFrame:
    """S5 / M-b on load: text dates -> DATE (NULL when unparseable), numeric
    text and DOUBLE -> the DECIMAL of the column (exact sums in any order).
    Other types pass through untouched."""
    out = df
    types = dict(df.dtypes)
    for c in ("order_date", "ship_date"):
        if c in types and types[c] != "date":
            col = F.col(c)
            if isinstance(df.schema[c].dataType, StringType):
                parsed = F.coalesce(col.try_cast("date"), F.try_to_timestamp(col).cast("date"))
            else:
                parsed = col.cast(DateType())
            out = out.withColumn(c, parsed)
    for c, exact in MONEY.items():
        if types.get(c) == "string":
            out = out.withColumn(c, clean_numeric(F.col(c)).cast(exact))
        elif types.get(c) in ("double", "float"):
            out = out.withColumn(c, F.col(c).cast(exact))
    return out


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """F1 (closed date range) and F2 (IN-list per dimension, AND between them).

    ``filters``: ``{"date_range": (start, end), "region": [...], ...}``;
    an empty list means no filter on that dimension.  Same predicates as the
    plan operators, so they reach the scan (and prune year directories).
    """
    from kpiforge.operators.filters import date_window, in_lists

    if not filters:
        return df
    dr = filters.get("date_range")
    if isinstance(dr, (tuple, list)) and len(dr) == 2:
        df = date_window(df, dr[0], dr[1])
    return in_lists(df, filters)


def load_orders(spark: SparkSession, path: str, filters: dict | None = None,
                fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Read a wide order-line table, coerce types, apply the filters.

    Rows stay on the executors; sort only the final (small) results.
    ``options`` go to the reader (e.g. ``{"header": "true"}`` for CSV).
    """
    df = spark.read.format(fmt).options(**(options or {})).load(path)
    return apply_filters(coerce_order_lines(df), filters)


def year_predicates(first_year: int, last_year: int, column: str = "order_date") -> list[str]:
    """One JDBC predicate per order year, so each year is read by its own task."""
    return [f"{column} >= DATE '{y}-01-01' AND {column} < DATE '{y + 1}-01-01'"
            for y in range(first_year, last_year + 1)]


def read_order_lines_jdbc(spark: SparkSession, url: str, table: str, properties: dict,
                          partition_column: str = "order_id", lower_bound: int = 0,
                          upper_bound: int = 0, num_partitions: int = 1,
                          predicates: list[str] | None = None) -> DataFrame:
    """Wide table from a database (the reference's PostgreSQL source).

    ``predicates`` (e.g. :func:`year_predicates`) or ``num_partitions > 1``
    (range split of ``partition_column``) make executors read in parallel.
    """
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    elif num_partitions > 1:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                             upperBound=upper_bound, numPartitions=num_partitions,
                             properties=properties)
    else:
        df = spark.read.jdbc(url, table, properties=properties)
    return coerce_order_lines(df)


def materialize_order_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the wide table once, partitioned by order year (directory pruning
    for F1).  Rows are sorted by date inside each task, so parquet row-group
    min/max statistics on ``order_date`` are tight and windows inside a year
    skip row groups too (the writer sorts by the partition column anyway).
    Rows are rebalanced by year first: AQE sizes the tasks and splits a large
    year, so a year gets a few files of useful size instead of one per task."""
    (df.withColumn("order_year", F.year("order_date"))
       .hint("rebalance", "order_year")
       .sortWithinPartitions("order_year", "order_date")
       .write.mode(mode).partitionBy("order_year").parquet(path))


def filter_options(df: DataFrame) -> DataFrame:
    """One row of sorted distinct regions / segments / categories and the date bounds.

    NULL values are dropped from the lists (D9).  ``collect_set`` is a partial
    aggregate, so only distinct values per task move.
    """
    return df.agg(
        F.sort_array(F.collect_set("region")).alias("regions"),
        F.sort_array(F.collect_set("segment")).alias("segments"),
        F.sort_array(F.collect_set("category")).alias("categories"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
    )


def latest_order_date(spark: SparkSession, sf_dir: str) -> date | None:
    """J3 without a pass over the star join: the date of the latest order line (None: there is none).

    The latest date of ``orders`` is nearly always it; whether a line joins to an
    order of that date is asked with ``take(1)``, which stops at the first one.
    """
    orders, lines = f"{sf_dir.rstrip('/')}/orders.parquet", order_lines(spark, sf_dir)
    last = extent(spark, orders, "o_orderdate").select(F.col("high").cast("date")).first()[0]
    if last is None or lines.where(F.col("order_date") == F.lit(last)).select("order_id").take(1):
        return last
    return lines.agg(F.max("order_date")).first()[0]


def latest_wide_date(spark: SparkSession, path: str) -> date | None:
    """J3 of a wide table (:func:`materialize_order_lines`): from its files' footers."""
    return extent(spark, path, "order_date").first()["high"]


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` rows by order date; ties broken on every column.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, only those are merged.
    """
    keys = [F.col("order_date").asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in df.columns if c != "order_date"]
    return df.orderBy(*keys).limit(n)


def run_sql(spark: SparkSession, df: DataFrame, sql: str, args: dict | None = None,
            view: str = "order_lines") -> DataFrame:
    """Run parameterised SQL over the order lines (named ``:param`` markers).

    The DataFrame is exposed as a temporary view; parameters are bound by
    Spark (no string formatting), like the reference's bound query params.
    """
    df.createOrReplaceTempView(view)
    return spark.sql(sql, args=args or {})
