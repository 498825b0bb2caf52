"""Quality selection by importance resampling over hashed n-grams.

Two generative models are counted over hashed word unigrams and bigrams (runs
of word characters and runs of punctuation are words): the raw model over all
documents, the target model over documents labelled good.  A document's log
importance weight is the sum over its n-grams of ``log p_target / p_raw``.
Documents are drawn without replacement in proportion to their weights: the
``k`` largest of ``log weight + Gumbel noise`` (:func:`resample`).

``k`` is not a constant: it is how many documents weigh at least the cut that
separates the labelled good from the labelled poor sample with the fewest
errors, so it follows the input.  Bounds: the target and the poor sample take
at most ``bound`` labelled documents each (the smallest hashes of their ids);
raw counts, weights and the draw cover every document and whole texts.

Cases.  Null or empty text: weight 0 (no n-gram), drawn like any other.
No good labels: all weights 0 and all documents kept.  No poor labels:
all kept.  Documents that tie with the k-th key are all kept.  Rows that
repeat a ``doc_id`` share its noise.  Null ``doc_id``: kept or not by its
text.  A document labelled both ways counts as poor.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import MULTIPLIERS, classes, hash_slices, mix, same_type, stored

BUCKETS = 1 << 18  # hashed n-gram features
CHUNKS = 64  # the counts travel and are summed in this many pieces
SMOOTHING = 3.0  # expected counts added on either side of a ratio
BOUND = 10_000  # labelled documents of either kind that are used at most
_WORDS = classes("\x20\x09\x0a\x0b\x0c\x0d", False, punctuation=True)


def features(col, buckets: int = BUCKETS):
    """Per slice: number of rows, hashed unigrams and bigrams, and each one's row."""
    for _, n, words, rows in hash_slices(col, _WORDS):
        pair = rows[1:] == rows[:-1]
        bigrams = mix(words[:-1] * MULTIPLIERS[1] + words[1:] * MULTIPLIERS[2])[pair]
        grams = (np.concatenate([words, bigrams]) % np.uint64(buckets)).astype(np.int64)
        yield n, grams, np.concatenate([rows, rows[1:][pair]])


def _count(buckets: int):
    size = buckets // CHUNKS

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(0)) == 1
            at = 0
            for n, grams, rows in features(batch.column(0), buckets):
                raw += np.bincount(grams, minlength=buckets)
                chosen = good[at: at + n][rows]
                if chosen.any():
                    target += np.bincount(grams[chosen], minlength=buckets)
                at += n
        yield pa.RecordBatch.from_arrays([
            pa.array(range(CHUNKS), pa.int32()), *[pa.array([x[k * size: (k + 1) * size].tobytes() for k in range(CHUNKS)], pa.binary()) for x in (raw, target)]],
            ["chunk", "raw", "target"])

    return run


def _add(key, table: pa.Table) -> pa.Table:
    total = [sum((np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()), np.int64(0)) for c in ("raw", "target")]
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([t.tobytes()], pa.binary()) for c, t in zip(("raw", "target"), total)}})


def _smallest(labels: DataFrame, value: int, bound: int) -> DataFrame:
    return labels.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled(labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """At most ``bound`` ids of either kind: ``doc_id, quality`` (1 good, 0 poor)."""
    own = same_type(labels, {"doc_id": "long", "quality": "int"}).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return _smallest(own, 1, bound).unionByName(_smallest(own, 0, bound))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND, buckets: int = BUCKETS):
    """Log ratio of the two models for each n-gram bucket, and the labelled sample."""
    sample = stored(labelled(labels, bound), "quality-sample")  # at most 2 * bound rows
    src = same_type(docs, {doc_id: "long", text: "string"}).join(F.broadcast(sample.withColumnRenamed("doc_id", doc_id)), doc_id, "left")
    add = _add
    rows = src.select(text, "quality").mapInArrow(_count(buckets), "chunk int, raw binary, target binary").groupBy("chunk").applyInArrow(
        lambda key, table: add(key, table), "chunk int, raw binary, target binary").collect()  # CHUNKS rows, 16 bytes a bucket
    if not rows:
        return np.zeros(buckets), sample
    rows.sort(key=lambda r: r["chunk"])
    raw, target = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]).astype(float) for c in ("raw", "target"))
    if not target.sum():
        return np.zeros(buckets), sample
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING)), sample


def log_weights(col, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log importance weight and number of n-grams of each text."""
    weight, size = [], []
    for n, grams, rows in features(col, len(ratio)):
        weight.append(np.bincount(rows, weights=ratio[grams], minlength=n))
        size.append(np.bincount(rows, minlength=n))
    return (np.concatenate(weight), np.concatenate(size)) if weight else (np.zeros(0), np.zeros(0, np.int64))


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise fixed by the key and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _scored(ratio: np.ndarray):
    ratio = ratio.astype(np.float32)

    def run(batches):
        for batch in batches:
            weight, size = log_weights(batch.column(1), ratio)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(size.astype(np.int64)), batch.column(2), batch.column(3)],
                                             ["doc_id", "log_weight", "n_grams", "noise", "quality"])

    return run


def score(docs: DataFrame, ratio: np.ndarray, sample: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, log_weight, n_grams, noise, quality`` (of the labelled sample, else null), written once."""
    src = same_type(docs, {doc_id: "long", text: "string"}).join(F.broadcast(sample.withColumnRenamed("doc_id", doc_id)), doc_id, "left")
    src = src.select(F.col(doc_id).alias("doc_id"), text, gumbel(F.col(doc_id), seed).alias("noise"), "quality")
    return stored(src.mapInArrow(_scored(ratio), "doc_id long, log_weight double, n_grams long, noise double, quality int"), "weights")


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest poor weights at or above it plus good ones below it; -inf if there are no poor ones."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    able = np.concatenate([[True], w[1:] != w[:-1], [True]])
    best = errors[able].min()
    at = np.flatnonzero(able & (errors == best))
    k = int(at[len(at) // 2])
    return float((w[k - 1] + w[k]) / 2) if 0 < k < len(w) else (-np.inf if k == 0 else np.inf)


def kth_largest(values: DataFrame, col: str, k: int, bins: int = 4096, settle: int = 10_000) -> float:
    """The k-th largest value, by counting in ever finer bins; at most ``settle`` values reach the driver."""
    low, high, n = values.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    for _ in range(6):
        if n <= settle or low == high:
            break
        width = (high - low) / bins
        place = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = values.where(F.col(col).between(low, high))
        stats = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(stats, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if low == high or n > settle:
        return float(low)
    found = sorted((r[0] for r in values.where(F.col(col).between(low, high)).select(col).collect()), reverse=True)
    return float(found[k - above - 1])


def threshold(weights: DataFrame) -> float:
    """Key of the last document drawn."""
    known = weights.where("quality IS NOT NULL").select("log_weight", "quality").toPandas()  # at most the labelled sample
    cut = best_cut(known["log_weight"].to_numpy(float), known["quality"].to_numpy() == 1)
    if cut == -np.inf:
        return -np.inf
    k = weights.where(F.col("log_weight") >= F.lit(cut)).count()
    return kth_largest(weights.select((F.col("log_weight") + F.col("noise")).alias("key")), "key", k)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents drawn: ``doc_id, log_weight, n_grams, key``."""
    ratio, sample = fit(docs, labels, doc_id, text)
    weights = score(docs, ratio, sample, seed, doc_id, text)
    last = threshold(weights)
    return weights.withColumn("key", F.col("log_weight") + F.col("noise")).where(F.col("key") >= F.lit(last)).select("doc_id", "log_weight", "n_grams", "key")


def keep(docs: DataFrame, labels: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns: texts are scored once more where they lie, not shuffled."""
    ratio, sample = fit(docs, labels, doc_id, text)
    last = threshold(score(docs, ratio, sample, seed, doc_id, text))
    ratio32, own = ratio.astype(np.float32), f"noise_of_{doc_id}"
    while own in docs.columns:
        own += "_"
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            weight, _ = log_weights(batch.column(at), ratio32)
            drawn = weight + np.asarray(batch.column(batch.num_columns - 1)) >= last
            yield batch.filter(pa.array(drawn)).select(list(range(batch.num_columns - 1)))

    return docs.withColumn(own, gumbel(F.col(doc_id).cast("long"), seed)).mapInArrow(run, docs.schema)
