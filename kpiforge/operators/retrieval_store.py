"""A TF-IDF index that takes additions, replacements and deletions.

The reference fits its index anew whenever a fact changes.  A
:class:`TfidfStore` keeps the term frequencies of each update in a segment of
its own and reads documents once, when they come:

* ``update(add, delete)`` packs the new documents' words into a segment, notes the
  deleted ids as tombstones, and writes the next version of the document
  frequencies: those of the version before, plus the new segment's, minus those
  of documents that were deleted or came again (an id that comes again replaces
  its document);
* ``index()`` gives a :class:`TfidfIndex` of the documents that count.  Idf
  values change for every token with every update, so norms are sums over the
  live words; no text is read again.

A version counts once its document frequencies are completely written; an
update that failed leaves the one before, and can be made again.  Ids in
``delete`` that come in ``add`` too are added.  An update's own duplicates:
as in :func:`fit_tfidf`, the smallest text of an id stays.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.operators.retrieval import ONE_FILE, TfidfIndex, few, id_type, packed_texts, tfidf_index, token_buckets, weighed
from kpiforge.operators.retrieval_blocks import DEALT, blocks_schema, count_bucket, deal_tokens, keep_places
from kpiforge.sources.tables import newest_version, shared_table


class TfidfStore:
    """Folders below ``path`` (a shared folder): ``terms`` (blocks of words), ``ids``, ``gone`` by segment, ``df`` by version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def version(self) -> int:
        return newest_version(self.spark, f"{self.path}/df")

    def _segments(self, name: str, upto: int, first: int = 0) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(
            *[f"{self.path}/{name}/segment={k}" for k in range(first, upto + 1)])

    def _live(self, version: int) -> DataFrame:
        """``doc_id, block, place`` of the documents that count: the last one of an id, unless it was deleted later."""
        at = F.struct("segment", "block", "place")
        last = self._segments("ids", version).groupBy("doc_id").agg(F.max(at).alias("at")).select("doc_id", "at.*")
        gone = self._segments("gone", version).groupBy("doc_id").agg(F.max("segment").alias("gone"))
        return last.join(gone, "doc_id", "left").where("gone IS NULL OR gone <= segment").select("doc_id", "block", "place")

    def _blocks(self, version: int, docs: DataFrame, n_docs: int) -> DataFrame:
        """Blocks of ``docs(block, place)`` alone."""
        places = docs.groupBy("block").agg(F.collect_list("place").alias("places"))
        blocks = self._segments("terms", version).drop("segment")
        return few(places, n_docs).join(blocks, "block").mapInArrow(keep_places, blocks_schema(id_type(blocks)))

    def _frequencies(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/df/version={version}")

    def update(self, add: DataFrame | None = None, delete: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> int:
        """Take in documents and deletions; returns the new version."""
        k = self.version + 1
        if add is None and k == 0:
            raise ValueError("the first update adds documents")
        kind = add.schema[id_col].dataType if add is not None else self._segments("ids", 0).schema["doc_id"].dataType
        empty = self.spark.range(0).select(F.col("id").cast("string").cast(kind).alias("doc_id"), F.lit("").alias("text"))
        added = packed_texts(empty, "doc_id", "text") if add is None else packed_texts(add, id_col, text_col, k << 44)
        added.write.mode("overwrite").options(**ONE_FILE).parquet(f"{self.path}/terms/segment={k}", compression="zstd")
        added = self.spark.read.schema(added.schema).parquet(f"{self.path}/terms/segment={k}")
        added.select("block", F.posexplode("ids").alias("place", "doc_id")).write.mode("overwrite").parquet(f"{self.path}/ids/segment={k}")
        gone = empty.select("doc_id") if delete is None else delete.select(F.col(id_col).cast(kind).alias("doc_id")).distinct()
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/segment={k}")
        of = self._frequencies(k - 1).select("of").first() if k else None
        buckets = of["of"] if of else token_buckets(self.spark)
        df = added.mapInArrow(deal_tokens(buckets), DEALT)
        if k:
            came, went = self._segments("ids", k, k).select("doc_id"), self._segments("gone", k, k).select("doc_id")
            out = shared_table(self._live(k - 1).join(came.unionByName(went).distinct(), "doc_id", "left_semi"), "tfidf-out")
            lost = self._blocks(k - 1, out, out.count()).mapInArrow(deal_tokens(buckets, -1), DEALT)
            df = self._frequencies(k - 1).drop("of").unionByName(df).unionByName(lost)
        count = count_bucket(False)
        df = df.groupBy("bucket").applyInArrow(lambda t: count(t), DEALT).withColumn("of", F.lit(buckets))
        df.write.mode("overwrite").parquet(f"{self.path}/df/version={k}", compression="zstd")
        return k

    def index(self, version: int | None = None) -> TfidfIndex:
        """The index of the documents that count."""
        version = self.version if version is None else version
        live = shared_table(self._live(version), "tfidf-live")
        n_docs = live.count()
        df = self._frequencies(version)
        of = df.select("of").first()
        buckets = of["of"] if of else token_buckets(self.spark)
        # a document without an id counts, but has no terms
        named = F.col("doc_id").isNotNull()
        blocks = shared_table(self._blocks(version, live.where(named), n_docs), "tfidf-texts", "zstd", **ONE_FILE)
        index = tfidf_index(blocks, weighed(blocks, n_docs, buckets)[1], df.drop("of"), n_docs, buckets)
        return replace(index, docs=index.docs.unionByName(live.where(~named).select("doc_id", F.lit(0.0).alias("norm"))))
