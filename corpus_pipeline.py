"""A training corpus from ``documents``: each stage works on all that its predecessor kept.

Stages, each one operator of :mod:`kpiforge.llm` with production parameters:

1. ``quality``: documents that importance resampling does not draw go.
2. ``line_dedup``: lines of templates that recur in three or more documents
   and passages of 50 words or more that two documents share go, except in the
   first of them; ``n_chars`` follows the text.  A document
   all of whose lines went (a copy of others) goes with them.
3. ``near_duplicates``: of documents linked by five-word shingles (Jaccard
   similarity of 0.75 or more) the one with the smallest id stays (no id comes
   last, the smallest hash of id and text decides between equal ids).  Rows
   that repeat an id with its text count as one document, with another text as
   documents of their own; rows without an id are documents like others.
4. ``decontamination``: documents that a benchmark item leaks into go.
5. ``packing``: what is left as pieces of sequences of at most 4096 ids.

All but the last return the columns of ``documents``.  Empty tables give
empty results; null texts are kept as they are by stages 2 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import decontam, line_dedup, ngram_join, packing, resample
from kpiforge.llm.common import stored
from kpiforge.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample.keep(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(docs).where("n_dropped = 0 OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is known by its id and text: rows that repeat an id with another text are documents of their own
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    rows = rows.groupBy("key", "component_id").agg(F.count("*").alias("n"))
    rows = stored(rows.join(docs.select(key.alias("key"), "doc_id").distinct(), "key"), "components")
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("stays"))
    # texts meet the (shorter) list of keys that go or repeat, written first: Spark broadcasts it only where its size is small
    special = stored(rows.join(stays, "component_id").select("key", (F.col("key") != F.col("stays.key")).alias("goes"), "n").where(
        "goes OR n > 1"), "rows-that-go-or-repeat")
    known = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    single = known.join(special.select("key"), "key", "left_anti")
    again = known.join(special.where("NOT goes").select("key"), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return single.unionByName(again).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("class")


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]

ORACLE_SQL = None  # a drawn sample and trained weights are not SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}-{name}")
    return docs
