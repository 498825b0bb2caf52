"""Plain parquet access to the driver tables (one parquet per table)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    Spark splits files by ``spark.sql.files.maxPartitionBytes`` and row group.
    ``partitions``, if the caller gives it, deals the rows round-robin (never
    by a key, so no key is hot): of use for a file that was written as one
    row group.  The plan never depends on how large the input is.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(partitions) if partitions else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def shared_table(df: DataFrame, name: str, compression: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    neither recompute it nor lose it with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest_version(spark: SparkSession, folder: str) -> int:
    """The highest ``version=N`` below ``folder`` whose write is complete (-1: none)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS"))
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in done or ()), default=-1)


def extent(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row ``low, high`` of a Parquet column, planned so that the files' footers answer it (numbers and dates; other types
    are read, that one column).  Aggregates reach the footers through the second reader of Spark's Parquet source only, so
    this plan has a session of its own and leaves the settings of ``spark`` alone."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.min(column).alias("low"), F.max(column).alias("high"))
