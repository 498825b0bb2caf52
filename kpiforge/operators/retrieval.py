"""Sparse TF-IDF retrieval over any ``(id, text)`` table.

The index is three tables: term frequencies ``(doc_id, tok, tf)``, ``(tok,
idf)`` and one row per document ``(doc_id, norm)``, which are read from packed
ones: texts as blocks of word numbers, document frequencies by bucket of
tokens, norms by block.  A batch of queries is scored from the terms the
queries hold; work follows the postings that share a token with a query, not
N x V.

Semantics (same as the reference):
* documents are de-duplicated by id first (U2; of several texts the smallest
  in text order stays, so the result does not depend on row order);
* tokens: lower-cased ``[a-z0-9_]+`` plus adjacent pairs joined with ``_``;
* tf = count / tokens in the doc; idf = ln((N + 1) / (df + 1)) + 1, N counts
  every document (also empty texts); documents are L2-normalised;
* a query uses raw counts x idf of the tokens the index knows, L2-normalised;
  score = cosine, rounded to ``digits`` decimals (``SCORE_DIGITS``, about the
  float32 precision the reference scores with) before ranking, so that ties
  do not hang on summation order, which differs between partitionings and
  engines by ~1e-14;
* ties: id ascending (the reference's order comes from an unstable argsort).
  Documents sharing no token with the query (score 0) are not returned.

Scale.  Fitting moves ids once, and of the texts only those whose id comes
again.  Texts are written once as blocks of word numbers; terms are made from
a block in each task that needs them and are never stored.  For document
frequencies a block's distinct tokens move to their buckets and the numbers
come back; for norms the blocks move once.  Top-k retrieval is exact and
quadratic (documents x queries) by nature: each block of documents meets each
block of queries in a task that reads both where they are written, and scores
them in tables of bounded size, so that disk follows the texts, never
query-document pairs; at most k rows per query and block move on.  Only
:func:`score` returns a row for each pair.  Sides are broadcast only where
Spark finds them small; norms also where they are few (``FEW_DOCS``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.functions.text import truncate, unigrams, with_bigrams
from kpiforge.operators.retrieval_blocks import (CHARS, DEALT, best_of_blocks, block_norms, block_vectors, blocks_schema, contexts, count_bucket, deal_tokens,
                                                 find_in_bucket, list_terms, list_tokens, pack_words)
from kpiforge.sources.tables import shared_table

SCORE_DIGITS = 7
BLOCK_DOCS, BLOCK_QUERIES = 1 << 15, 1 << 14  # documents that one task of a bounded search scores, and queries of a block, about
PART = 1 << 27        # bytes of texts in the prompts that one task puts together, about
FEW_DOCS = 1 << 22    # norms of so many documents (8 bytes each) are sent to all tasks
ONE_FILE = {"maxRecordsPerFile": "1"}  # a block is a few MB: each is read by itself


@dataclass(frozen=True)
class TfidfIndex:
    terms: DataFrame  # doc_id, tok, tf
    idf: DataFrame    # tok, idf
    docs: DataFrame   # doc_id, norm (0 for a document without tokens): every indexed document
    blocks: DataFrame  # texts as blocks of word numbers (retrieval_blocks.blocks_schema)
    norms: DataFrame  # block, norms of its documents in their order
    dfs: DataFrame    # document frequencies, packed by bucket of tokens (retrieval_blocks.DEALT)
    n_docs: int
    buckets: int      # of tokens

    @property
    def postings(self) -> DataFrame:
        """Normalised weights ``(doc_id, tok, w)``."""
        return (self.terms.join(self.idf, "tok").join(self.docs, "doc_id")
                    .select("doc_id", "tok", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w")))


def distinct_documents(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, text)`` per id."""
    return df.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(text_col).alias("text"))


def token_rows(df: DataFrame, id_col: str, text_col: str, out_id: str,
               with_length: bool = False) -> DataFrame:
    """``(id, [n_tok,] tok)``: one row per token occurrence (unigrams + bigrams).

    The regex runs once per text: the unigram array is its own projection and
    the bigrams are built from that column (Catalyst does not inline a costly
    expression that is referenced several times).
    """
    u = df.select(F.col(id_col).alias(out_id), unigrams(F.col(text_col)).alias("_u"))
    t = u.select(out_id, with_bigrams(F.col("_u")).alias("_t"))
    cols = [out_id] + ([F.size("_t").alias("n_tok")] if with_length else [])
    # explode_outer + NULL filter: plain explode makes Catalyst infer a
    # ``size(tokens) > 0`` filter that it pushes below the projection, which
    # would run the whole tokenizer a second time per text
    return t.select(*cols, F.explode_outer("_t").alias("tok")).filter(F.col("tok").isNotNull())


def one_per_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)``, one row per id; texts move only where many ids, or this one, come again."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    n, again = ids.agg(F.sum("c"), F.sum(F.when(F.col("c") > 1, F.col("c")))).first()
    if not again:
        return rows
    if 16 * again > n:
        return distinct_documents(rows, "doc_id", "text")
    twice = shared_table(ids.where("c > 1").select(F.col("doc_id").alias("id")), "tfidf-ids-again")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return rows.join(twice, same, "left_anti").unionByName(distinct_documents(rows.join(twice, same, "left_semi"), "doc_id", "text"))


def packed_texts(df: DataFrame, id_col: str, text_col: str, first: int = 0) -> DataFrame:
    """Blocks of words of distinct documents, numbered from ``first``."""
    one = one_per_id(df, id_col, text_col).select("doc_id", F.lower("text").alias("text"))
    return one.mapInArrow(pack_words(first), blocks_schema(one.schema["doc_id"].dataType.simpleString()))


def block_terms(blocks: DataFrame) -> DataFrame:
    """``doc_id, tok, c, n_tok``: how often a token comes, and how many tokens the document has."""
    return blocks.mapInArrow(list_terms, f"doc_id {id_type(blocks)}, tok string, c int, n_tok int")


def id_type(blocks: DataFrame) -> str:
    return blocks.schema["ids"].dataType.elementType.simpleString()


def token_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_tf(terms: DataFrame) -> DataFrame:
    return terms.withColumn("tf", F.col("c") / F.col("n_tok"))


def fit_tfidf(df: DataFrame, id_col: str = "id", text_col: str = "text") -> TfidfIndex:
    """Texts as blocks of words, document frequencies and norms, written once to the shared folder."""
    blocks = shared_table(packed_texts(df, id_col, text_col), "tfidf-texts", "zstd", **ONE_FILE)
    n_docs = blocks.select(F.size("ids").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = token_buckets(df.sparkSession)
    dfs, norms = weighed(blocks, n_docs, buckets)
    return tfidf_index(blocks, norms, dfs, n_docs, buckets)


def tfidf_index(blocks: DataFrame, norms: DataFrame, dfs: DataFrame, n_docs: int, buckets: int) -> TfidfIndex:
    """The index whose tables are read from packed ones."""
    idf = dfs.mapInArrow(list_tokens, "tok string, df long").select("tok", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    docs = few(norms, n_docs).join(blocks.select("block", "ids"), "block").select(
        F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("norms").alias("norm"))).alias("d")).select("d.doc_id", "d.norm")
    # null is no id of a document
    docs = docs.select("doc_id", F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.col("norm")).alias("norm"))
    return TfidfIndex(with_tf(block_terms(blocks)), idf, docs, blocks, norms, dfs, n_docs, buckets)


def few(norms: DataFrame, n_docs: int) -> DataFrame:
    return F.broadcast(norms) if n_docs <= FEW_DOCS else norms


def weighed(blocks: DataFrame, n_docs: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Document frequencies (``DEALT``) of the tokens of ``blocks``, and ``(block, norms)``.

    A block's distinct tokens go to their buckets, each once; back come their frequencies, for each block in the order in
    which it gave them.  With these the block is weighed.
    """
    count = count_bucket(True)
    counted = shared_table(blocks.mapInArrow(deal_tokens(buckets), DEALT).groupBy("bucket").applyInArrow(lambda t: count(t), DEALT),
                           "tfidf-frequencies", "zstd")
    norms = with_frequencies(blocks, counted.where("block IS NOT NULL"), block_norms(buckets, n_docs), "block long, norms array<double>")
    return counted.where("block IS NULL"), shared_table(norms, "tfidf-norms")


def with_frequencies(blocks: DataFrame, back: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over each block and the frequencies of its tokens."""
    rows = blocks.unionByName(back.select("block", "bucket", "n", "dfs"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(lambda t: step(t), schema)


def save_index(index: TfidfIndex, path: str, buckets: int = 0) -> TfidfIndex:
    """Write the index under ``path`` (a shared folder) and read it back.

    Terms are dealt by document (into ``buckets`` files, or as many as the
    session's shuffle partitions) and sorted by token inside a file, so row
    groups carry narrow token ranges and a batch skips what it has no use for.
    """
    spark = index.terms.sparkSession
    terms = index.terms.repartition(buckets, "doc_id") if buckets else index.terms.repartition("doc_id")
    terms.sortWithinPartitions("tok").write.mode("overwrite").parquet(f"{path}/terms")
    index.idf.write.mode("overwrite").parquet(f"{path}/idf")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    for name, packed in (("blocks", index.blocks), ("norms", index.norms), ("dfs", index.dfs)):
        packed.write.mode("overwrite").options(**ONE_FILE if name == "blocks" else {}).parquet(f"{path}/{name}", compression="zstd")
    return TfidfIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("terms", "idf", "docs", "blocks", "norms", "dfs")), index.n_docs, index.buckets)


def query_vectors(index: TfidfIndex, queries: DataFrame, qid_col: str = "qid",
                  text_col: str = "text") -> DataFrame:
    """``(qid, tok, qw, idf)``: normalised query weights over known tokens only."""
    # written, so that its size is known when the join with the idf of all tokens is planned
    q = shared_table(token_rows(queries, qid_col, text_col, "qid")
                     .groupBy("qid", "tok").agg(F.count(F.lit(1)).alias("c")), "query-tokens")
    qv = q.join(index.idf, "tok").select("qid", "tok", "idf", (F.col("c") * F.col("idf")).alias("_q"))
    norm = F.sqrt(F.sum(F.col("_q") * F.col("_q")).over(Window.partitionBy("qid")))
    return qv.select("qid", "tok", (F.col("_q") / norm).alias("qw"), "idf")


def score(index: TfidfIndex, queries: DataFrame, qid_col: str = "qid", text_col: str = "text",
          digits: int = SCORE_DIGITS) -> DataFrame:
    """R2: ``(qid, doc_id, score)`` for every document sharing a token with a query."""
    qv = shared_table(query_vectors(index, queries, qid_col, text_col), "query-vectors")
    terms = index.terms.join(qv.select("tok").distinct(), "tok", "left_semi").repartition("doc_id")
    hits = terms.join(qv, "tok").groupBy("doc_id", "qid").agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("_s"))
    return hits.join(index.docs, "doc_id").select("qid", "doc_id", F.round(F.col("_s") / F.col("norm"), digits).alias("score"))


def packed_queries(index: TfidfIndex, queries: DataFrame, qid_col: str = "qid", text_col: str = "text") -> DataFrame:
    """Blocks of queries, each with its known tokens and their normalised weights times idf; texts of an id are one query."""
    q = shared_table(queries.groupBy(F.col(qid_col).alias("qid")).agg(F.collect_list(F.lower(text_col)).alias("texts")), "queries")
    n, size = q.agg(F.count(F.lit(1)), F.sum(F.aggregate("texts", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x)))).first()
    over = max(1, -(-n // BLOCK_QUERIES), -(-(size or 0) // CHARS))
    kind = q.schema["qid"].dataType.simpleString()
    blocks = shared_table(q.repartition(over, "qid").mapInArrow(pack_words(), blocks_schema(kind)), "query-texts", "zstd")
    asked = blocks.mapInArrow(deal_tokens(index.buckets), DEALT).unionByName(index.dfs)
    found = asked.groupBy("bucket").applyInArrow(lambda t: find_in_bucket(t), DEALT)
    vectors = with_frequencies(blocks, found, block_vectors(index.buckets, index.n_docs),
                               f"qblock long, qids array<{kind}>, qn int, qtoks binary, qlens binary, qrow binary, qcode binary, qw binary")
    return shared_table(vectors, "query-vectors", "zstd", **ONE_FILE)


def retrieve(index: TfidfIndex, queries: DataFrame, k: int = 6, qid_col: str = "qid",
             text_col: str = "text", digits: int = SCORE_DIGITS) -> DataFrame:
    """Top ``k`` documents per query: ``(qid, doc_id, score, rank)``.

    Every block of documents meets every block of queries; a pair is scored in one task, a table of at most
    ``CHUNK_QUERIES`` by ``CHUNK_DOCS`` scores at a time, and gives at most k rows a query.
    """
    asked = packed_queries(index, queries, qid_col, text_col)
    pairs = index.blocks.join(few(index.norms, index.n_docs), "block").crossJoin(asked)
    schema = f"qid {asked.schema['qids'].dataType.elementType.simpleString()}, doc_id {id_type(index.blocks)}, score double"
    best = shared_table(pairs.mapInArrow(best_of_blocks(k, digits), schema), "best-of-blocks")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (best.withColumn("rank", F.row_number().over(w).cast("long"))
                .filter(F.col("rank") <= k))


def retrieve_pinned(index: TfidfIndex, queries: DataFrame, k: int = 6, min_score: float = 0.03,
                    pinned_ids=(), qid_col: str = "qid", text_col: str = "text",
                    extra_candidates: int = 4) -> DataFrame:
    """The engine's retrieval.

    Take the top ``k + 4`` candidates, keep those scoring at least
    ``min_score`` (R4), add every pinned id that is missing and in the index
    (score 0), then order: pinned first (candidates in score order, then the
    rest in the given order), others by score (R5).  ``position`` is 1-based.
    """
    cand = retrieve(index, queries, k + extra_candidates, qid_col, text_col)
    hits = cand.filter(F.col("score") >= min_score).select("qid", "doc_id", "score", F.col("rank").alias("_c"))
    out = hits
    if pinned_ids:
        given = F.array(*[F.lit(p) for p in pinned_ids]).cast(f"array<{index.docs.schema['doc_id'].dataType.simpleString()}>")
        order = F.array_position(given, F.col("doc_id")) - 1
        there = index.docs.filter(F.col("doc_id").isin(list(pinned_ids))).select("doc_id", order.cast("int").alias("_p"))
        pins = queries.select(F.col(qid_col).alias("qid"), F.explode(F.array_distinct(given)).alias("doc_id"))
        out = hits.join(pins.join(there, "doc_id"), ["qid", "doc_id"], "full_outer")
    else:
        out = out.withColumn("_p", F.lit(None).cast("int"))
    pinned = F.col("_p").isNotNull()
    order = Window.partitionBy("qid").orderBy(
        F.when(pinned, 0).otherwise(1),
        F.when(pinned & F.col("_c").isNotNull(), 0).otherwise(1),
        F.when(pinned, F.col("_c")), F.when(pinned, F.col("_p")),
        F.col("score").desc_nulls_last(), F.col("_c").asc_nulls_last())
    return out.select(
        "qid", "doc_id", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        pinned.alias("pinned"), F.row_number().over(order).cast("long").alias("position"))


def context_block(ranked: DataFrame, docs: DataFrame, id_col: str = "id", text_col: str = "text",
                  summaries: DataFrame | None = None, max_chunks: int = 6) -> DataFrame:
    """Prompt section per query from ranked ids and an optional chat summary.

    ``[Recent conversation]`` + summary (when given), then
    ``[Verified data facts from dashboard]`` and ``  - text`` for the first
    ``max_chunks`` results.  ``summaries``: ``(qid, summary)``.
    """
    top = shared_table(ranked.filter(F.col("position") <= max_chunks).select("qid", "doc_id", "position"), "context-ranked")
    named = shared_table(top.select(F.col("doc_id").alias(id_col)).distinct(), "context-ids")
    texts = shared_table(distinct_documents(docs.join(named, id_col, "left_semi"), id_col, text_col), "context-texts", "zstd")
    # a query without a list has no facts; only documents that are there count
    found = top.join(texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "doc_id")
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id"))).alias("docs"), F.sum("n").alias("n"))
    if summaries is not None:
        lists = lists.join(summaries.select("qid", F.col("summary").alias("_s")), "qid", "full_outer")
    else:
        lists = lists.withColumn("_s", F.lit(None).cast("string"))
    head = F.when(F.coalesce(F.col("_s"), F.lit("")) != "", F.concat(F.lit("[Recent conversation]\n"), F.col("_s")))
    lists = shared_table(lists.select("qid", head.alias("head"), F.col("docs"), F.coalesce("n", F.lit(0)).alias("n")), "context-lists", "zstd")
    alone = lists.where("docs IS NULL").select("qid", F.concat_ws("\n", "head").alias("context"))
    # queries with the same first document lie in a part, which holds each text once however many of them name it
    size = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = lists.where("docs IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64(F.col("docs")[0]["doc_id"]), F.lit(1 + size // PART)))
    shares = dealt.groupBy("bucket").agg((1 + F.floor(F.sum("n") / PART)).alias("shares"))
    dealt = dealt.join(shares, "bucket").withColumn("part", F.struct("bucket", F.pmod(F.xxhash64("qid"), "shares").alias("share")))
    needed = dealt.select("part", F.explode("docs.doc_id").alias("doc_id")).distinct().join(texts, "doc_id").withColumn("there", F.lit(True))
    rows = dealt.select("part", "qid", "docs", "head").unionByName(needed, allowMissingColumns=True)
    kind = top.schema["qid"].dataType.simpleString()
    return alone.unionByName(rows.groupBy("part").applyInArrow(lambda t: contexts(t), f"qid {kind}, context string"))


__all__ = ["TfidfIndex", "distinct_documents", "fit_tfidf", "save_index", "query_vectors", "score", "retrieve",
           "retrieve_pinned", "context_block", "token_rows", "truncate"]
