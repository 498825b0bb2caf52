"""Near duplicates among embeddings by cross-polytope hashing.

``near_duplicates(rows)`` links two vectors of one label whose cosine, in
double precision, is at least ``cosine``, and returns for every vector how
many others it links with directly and the smallest id it reaches.

Equal vectors of a label form a class that is hashed once.  A hash rotates
the vector by three rounds of random signs and a fast Hadamard transform and
names the nearest vertex of the cross-polytope (the largest coordinate and its
sign); a table joins ``width`` hashes.  A vector lies in one home bucket of
each table and looks for partners in ``probes`` buckets, its own and those
whose coordinates come next.  Buckets in which nobody can meet are dropped
before vectors move.  In a bucket every candidate is verified by its exact
cosine; a pair is counted in the first table where it meets, so no list of
pairs is made: a block returns counts, and a spanning forest of its links.
Buckets of many vectors are cut into blocks of about ``BLOCK`` queries and
``BLOCK`` index vectors, every part of the one with every part of the other;
the number of groups that take blocks follows the number of their rows, so a
group holds a bounded number of vectors however many lie close together.

The number of tables and hashes follows the number of vectors (:func:`shape`).
With six tables of two hashes a pair at cosine 0.98 in 64 dimensions is missed
with probability 1e-5 (0.13 per table, measured); links below the threshold
never occur.

Cases.  Null, zero or empty vectors, vectors with a null or non-finite
component, and null labels link with nothing.  Lengths that are no power of
two are padded with zeros; vectors of different lengths never link.  Repeated
rows link with each other.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import components, mix, parts, same_type, stored

PROBES = 4
FULL = 16  # vectors for each bucket of a table, at most, before tables get one more hash


def shape(vectors: int, dims: int) -> tuple[int, int]:
    """Tables and hashes per table: two hashes, and one more for each factor of 2 * dims in the number of vectors beyond
    ``FULL`` a bucket; three tables per hash keep the recall."""
    width, room = 2, FULL * (2 * max(dims, 2)) ** 2
    while vectors > room:
        width, room = width + 1, room * 2 * max(dims, 2)
    return 3 * width, width


BLOCK = 2048  # queries, and index vectors, of one bucket that meet in one block
GROUP = 1 << 16  # rows of blocks, about, that one group takes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _signs(table: int, which: int, turn: int, d: int) -> np.ndarray:
    bits = mix(np.arange(d, dtype=np.uint64) + np.uint64(((table * 64 + which) * 8 + turn + 1) << 32))
    return np.where(bits & np.uint64(1), 1.0, -1.0)


def buckets(x: np.ndarray, table: int, width: int = 2, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers each row looks in; the first is its home."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    key, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for which in range(width):
        y = x
        for turn in range(3):
            y = hadamard(y * _signs(table, which, turn, d))
        size = np.abs(y)
        top = np.argsort(-size, 1, kind="stable")[:, :probes]
        value = np.take_along_axis(size, top, 1)
        vertex = 2 * top + (np.take_along_axis(y, top, 1) > 0)
        cost = value[:, :1] - value
        key = (key[:, :, None] * (2 * d) + vertex[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, 1, kind="stable")[:, :probes]
        key, loss = np.take_along_axis(key, best, 1), np.take_along_axis(loss, best, 1)
    return key


def _matrix(col) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def _keys(tables: int, width: int, probes: int):
    def run(batches):
        for batch in batches:
            cid, dims, label = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _matrix(batch.column(1).take(pa.array(own)))
                for t in range(tables):
                    key = buckets(x, t, width, probes)
                    n, p = key.shape
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(cid[own], p)), pa.array(np.full(n * p, t, np.int32)), pa.array(key.ravel()),
                        pa.array(np.tile(np.arange(p) == 0, n).astype(np.int32)), pa.array(np.repeat(label[own], p)),
                        pa.array(np.full(n * p, d, np.int32))], ["cid", "t", "bucket", "home", "label", "dims"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node of each of n nodes over edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def candidates(queries: np.ndarray, index: np.ndarray, first: np.ndarray, most: int = 1 << 17):
    """Pairs (query row, index row) of many blocks, a bounded number at a time; block k has ``queries[k]`` query rows from
    ``first[k]`` on, then ``index[k]`` index rows."""
    total = np.concatenate([[0], np.cumsum(queries * index)])
    for lo in range(0, int(total[-1]), most):
        p = np.arange(lo, min(lo + most, int(total[-1])))
        k = np.searchsorted(total, p, "right") - 1
        p = p - total[k]
        yield first[k] + p // index[k], first[k] + queries[k] + p % index[k]


def close_pairs(x: np.ndarray, queries: np.ndarray, index: np.ndarray, first: np.ndarray, cosine: float, large: int = 1 << 14):
    """Pairs of :func:`candidates` with at least the cosine: row by row, and as matrix products in large blocks."""
    norm = np.sqrt((x * x).sum(1))
    many = queries * index > large
    for a, b in candidates(queries[~many], index[~many], first[~many]):
        near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine * norm[a] * norm[b]
        yield a[near], b[near]
    for q, n, f in zip(queries[many].tolist(), index[many].tolist(), first[many].tolist()):
        for lo in range(f, f + q, 1024):
            hi = min(lo + 1024, f + q)
            for k in range(f + q, f + q + n, 1024):
                end = min(k + 1024, f + q + n)
                a, b = np.nonzero(x[lo:hi] @ x[k:end].T >= cosine * norm[lo:hi, None] * norm[None, k:end])
                yield a + lo, b + k


def _new_pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray, width: int, probes: int) -> np.ndarray:
    """Whether a pair that meets in table t has met in none before: its query row looked in no home bucket of its index row."""
    new = np.ones(len(a), bool)
    for s in range(int(t.max(initial=0))):
        on = np.flatnonzero(new & (t > s))
        if len(on):
            rows, at = np.unique(np.concatenate([a[on], b[on]]), return_inverse=True)
            key = buckets(x[rows], s, width, probes)
            met = (key[at[: len(on)]] == key[at[len(on):], :1]).any(1)
            new[on[met]] = False
    return new


def _verify(cosine: float, width: int, probes: int):
    """Blocks of one task: links of each query vector, and a spanning forest of all links found."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("label", "t", "bucket", "dims", "salt", "query", "cid", "copies")}
        vectors = table.column("v").combine_chunks()
        order = np.lexsort([cols["cid"], -cols["query"], *(cols[c] for c in ("salt", "bucket", "t", "label", "dims"))])
        cols = {c: v[order] for c, v in cols.items()}
        ids, place = np.unique(cols["cid"], return_inverse=True)
        links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for d in np.unique(cols["dims"]):
            rows = np.flatnonzero(cols["dims"] == d)
            x = _matrix(vectors.take(pa.array(order[rows])))
            own = {c: v[rows] for c, v in cols.items()}
            at = place[rows]
            key = np.stack([own[c] for c in ("label", "t", "bucket", "salt")], 1)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            size = np.diff(np.append(first, len(rows)))
            asked = np.add.reduceat(own["query"], first).astype(np.int64)
            for a, b in close_pairs(x, asked, size - asked, first, cosine):
                other = at[a] != at[b]
                a, b = a[other], b[other]
                new = _new_pairs(x, a, b, own["t"][a], width, probes)
                a, b = a[new], b[new]
                links += np.bincount(at[a], weights=own["copies"][b], minlength=len(ids)).astype(np.int64)
                low = _forest(np.concatenate([at[a], np.arange(len(ids))]), np.concatenate([at[b], low]), len(ids))
        keep = (links > 0) | (low != np.arange(len(ids)))
        return pa.table({"cid": ids[keep], "links": links[keep], "root": ids[low][keep]})

    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    tables: int | None = None, width: int | None = None, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (see the module text); tables and width by :func:`shape`."""
    src = same_type(rows, {vec_id: "long", vector: "array<double>", label: "long"}).select(
        F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    src = src.withColumn("cid", F.when(usable, F.xxhash64("label", "v")))
    classes = stored(src.where("cid IS NOT NULL").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
        .withColumn("dims", F.size("v")), "vectors")
    by_rule = shape(*classes.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(2))).first())
    tables, width = tables or by_rule[0], width or by_rule[1]
    keys = stored(classes.select("cid", "v", "dims", "label").mapInArrow(
        _keys(tables, width, probes), "cid long, t int, bucket long, home int, label long, dims int"), "buckets")
    place = ["label", "t", "bucket", "dims"]
    salts = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    sizes = stored(keys.groupBy(place).agg(F.sum("home").alias("homes"), F.count("*").alias("n")).where("homes > 0 AND n > 1").select(
        *place, "homes", "n", salts("n").alias("asks"), salts("homes").alias("holds")), "bucket-sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("holds") + F.col("homes") * F.col("asks"))).first()[0] or 0
    groups = max(4 * parts(rows.sparkSession), -(-total // GROUP))
    meet = keys.join(sizes, place)
    # each query lies in one part of the queries and meets all parts of the index, and the other way round
    part = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    queries = meet.withColumn("other", every("holds")).withColumn("salt", part("asks", 3) * F.col("holds") + F.col("other")).withColumn("query", F.lit(1))
    index = meet.where("home = 1").withColumn("other", every("asks")).withColumn(
        "salt", F.col("other") * F.col("holds") + part("holds", 5)).withColumn("query", F.lit(0))
    cols = [*place, "salt", "query", "cid"]
    check = _verify(cosine, width, probes)
    found = stored(queries.select(cols).unionByName(index.select(cols)).join(classes.select("cid", "v", "copies"), "cid")
                   .withColumn("task", F.pmod(F.xxhash64(*place, "salt"), F.lit(groups)))
                   .groupBy("task").applyInArrow(lambda t: check(t), "cid long, links long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    of = classes.select("cid", "copies", "low").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    of = of.withColumn("component", F.coalesce("component", "cid"))
    low = of.groupBy("component").agg(F.min("low").alias("least"))
    of = of.join(low, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    return src.select("vec_id", "cid").join(of, "cid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
