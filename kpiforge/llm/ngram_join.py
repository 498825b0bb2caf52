"""N-gram Jaccard join by T-occurrence search (DivideSkip).

``jaccard_components(docs)`` links two documents when the Jaccard similarity
of their sets of distinct word n-grams is at least ``percent / 100`` and
returns one row per document: ``doc_id``, ``n_shingles`` (size of its set),
``component_id`` (smallest ``doc_id`` reachable by links, itself included).

Method.  Sets become sorted 64-bit n-gram hashes.  Documents with the same set
form a class (named by a 64-bit hash of the set) that is searched once.

1. *Inverted lists.*  The n-grams go, packed by the few megabytes, to hash
   buckets.  A bucket drops lists with one class (they cannot add to an
   overlap), marks lists of more than ``LONG`` classes as long, and sends the
   rest back to the blocks of their documents.  An n-gram that already is
   long within one map task sends its count, not its members, to the bucket.
2. *T-occurrence.*  An overlap must reach ``T = ceil(percent * n / 100)``, so
   a class with fewer than T shared lists has no partner.  Of its s shared
   lists the ``T - 1`` longest can be left for probing: every partner occurs
   in one of the ``s - T + 1`` remaining lists, long ones last.
3. *Search.*  In each of those lists a leader is drawn; the class that leads
   is the query against the members (in salted blocks, so a leader of
   thousands is spread over many tasks).  A block builds the inverted lists
   of its members, heap-merges the query's short lists, binary-probes the long
   ones (:func:`divide_skip`) and keeps members that reach the overlap.
   After ``LEADERS`` such rounds every pair of classes in different components
   is searched at the first list it shares, if the lists after that suffice
   for the overlap.  A pair is left
   out only if its two classes are connected already or cannot reach the
   threshold, so the components are exact and a group of k copies costs
   about k searches, not k * k / 2.

Cases.  Null or empty text, or only white space: empty set, ``n_shingles`` 0,
``component_id`` its own ``doc_id``.  Fewer than n words: the whole sequence
is one n-gram.  A null ``doc_id`` keeps its row and takes part in links; it
never is the smallest id.  Rows that repeat a ``doc_id`` each keep their row.
Empty table: no rows.  Other columns are ignored.  Identity of n-grams and
sets is that of their 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import (
    FOLDED, MULTIPLIERS, binaries, components, hash_slices, mix, ngram_hashes, parts, same_type, stored)

LONG = 64  # an inverted list with more classes than this is long
FLUSH = 1 << 23  # bytes of n-gram hashes that a map task packs together
LEADERS = 1  # rounds in which a leader searches each list, before what is left is searched pair by pair
BLOCK = 512  # members searched by one task per leader
_PACKED = "dest int, kind int, keys binary, counts binary, hashes binary, flags binary"
_PACKED_ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                           ("hashes", pa.binary()), ("flags", pa.binary())])
_POSTINGS, _DOCS, _SIZES, _BACK = 0, 1, 2, 3


def text_sets(col, n: int = 5):
    """For each text its sorted distinct n-gram hashes (uint64), in row order."""
    for _, m, words, rows in hash_slices(col, FOLDED):
        grams = ngram_hashes(words, n)
        first = np.searchsorted(rows, np.arange(m + 1))
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(grams[lo: hi - n + 1])
            elif hi > lo:
                yield ngram_hashes(words[lo:hi], hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> np.uint64:
    """64-bit name of a set of hashes (order-free)."""
    parts_ = np.array([(s * MULTIPLIERS[6]).sum(dtype=np.uint64), len(s)], np.uint64) * MULTIPLIERS[[0, 7]]
    return mix(parts_.sum(dtype=np.uint64, keepdims=True))[0]


def need(n, percent: int):
    """Least overlap of a set of ``n`` with any partner."""
    return (percent * n + 99) // 100


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


def _row(dest, kind, keys, counts=b"", hashes=b"", flags=b""):
    return (int(dest), kind, bytes(keys), bytes(counts), bytes(hashes), bytes(flags))


def _packed(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACKED_ARROW)], schema=_PACKED_ARROW)


def _map_postings(n: int, buckets: int):
    """Map side: sets of a task's documents, packed by bucket."""

    def pack(ids: list, sets: list):
        names = np.array([set_id(s) for s in sets], np.uint64)
        sizes = np.array([len(s) for s in sets], np.uint64)
        # ids: (doc_id, is null) of every row, with the name and size of its set
        yield _row(int(names[0] >> np.uint64(40)) % buckets if len(names) else 0, _DOCS,
                   np.array([i for i, _ in ids], np.int64).tobytes(), np.array([z for _, z in ids], np.uint8).tobytes(),
                   names.tobytes(), sizes.tobytes())
        _, one = np.unique(names, return_index=True)
        one = one[sizes[one] > 0]
        if not len(one):
            return
        names, counts = names[one], sizes[one].astype(np.int64)
        block = (names % np.uint64(buckets)).astype(np.int64)
        for d in np.unique(block):
            yield _row(d, _SIZES, names[block == d].tobytes(), sizes[one][block == d].astype(np.uint32).tobytes())
        hashes = np.concatenate([sets[k] for k in one])
        owner = np.repeat(np.arange(len(one)), counts)
        order = np.argsort(hashes)
        start, length = _runs(hashes[order])
        hot = np.zeros(len(hashes), bool)
        many = length > LONG
        if many.any():
            hot[order[np.repeat(many, length)]] = True
        hot_hash, hot_count = hashes[order[start[many]]], length[many].astype(np.uint64)
        hot_bucket = ((hot_hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if many.any():  # members of lists that are long already go straight to their documents
            h, o = hashes[hot], owner[hot]
            for d in np.unique(block):
                mine = block[o] == d
                if mine.any():
                    c = np.bincount(o[mine], minlength=len(one))
                    yield _row(d, _BACK, names[c > 0].tobytes(), c[c > 0].astype(np.uint32).tobytes(), h[mine].tobytes(),
                               np.ones(int(mine.sum()), np.uint8).tobytes())
        h, o = hashes[~hot], owner[~hot]
        bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        h, o, bucket = h[by], o[by], bucket[by]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            mine = hot_bucket == b
            if hi > lo or mine.any():
                s, c = _runs(o[lo:hi])
                yield _row(b, _POSTINGS, names[o[lo:hi][s]].tobytes(), c.astype(np.uint32).tobytes(), h[lo:hi].tobytes(),
                           np.stack([hot_hash[mine], hot_count[mine]], 1).tobytes())

    def run(batches):
        ids, sets, held = [], [], 0
        for batch in batches:
            key = batch.column(0)
            null = np.asarray(key.is_null())
            value = np.asarray(key.fill_null(0))
            for k, s in enumerate(text_sets(batch.column(1), n)):
                ids.append((int(value[k]), bool(null[k])))
                sets.append(s)
                held += 8 * len(s) + 64
                if held >= FLUSH:
                    yield _packed(list(pack(ids, sets)))
                    ids, sets, held = [], [], 0
        if ids:
            yield _packed(list(pack(ids, sets)))

    return run


def _bucket_lists(buckets: int):
    """One bucket: count the classes of every list, drop lists of one, send the rest back by document block."""

    def run(table: pa.Table) -> pa.Table:
        out, names, hashes, hot = [], [], [], []
        heads = [table.column(k).to_pylist() for k in range(2)]
        for dest, kind, keys, counts, hs, flags in zip(*heads, *[binaries(table.column(k)) for k in range(2, 6)]):
            if kind != _POSTINGS:
                out.append(_row(dest, kind, keys, counts, hs, flags))
                continue
            names.append(np.repeat(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)))
            hashes.append(np.frombuffer(hs, np.uint64))
            hot.append(np.frombuffer(flags, np.uint64).reshape(-1, 2))
        if hashes:
            h, c = np.concatenate(hashes), np.concatenate(names)
            long_hash = np.unique(np.concatenate(hot)[:, 0])
            del hashes, names
            by = np.argsort(h)
            h = h[by]
            c = c[by]
            del by
            start, length = _runs(h)
            is_long = np.isin(h[start], long_hash)
            keep = np.repeat((length > 1) | is_long, length)
            is_long = np.repeat(is_long, length)[keep]
            h, c = h[keep], c[keep]
            by = np.lexsort((c, h))  # copies of one set from several map tasks count once
            h, c, is_long = h[by], c[by], is_long[by]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c, is_long = h[first], c[first], is_long[first]
            start, length = _runs(h)
            is_long |= np.repeat(length > LONG, length)
            keep = np.repeat(length > 1, length) | is_long
            h, c, is_long = h[keep], c[keep], is_long[keep]
            block = (c % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((c, block))
            h, c, is_long, block = h[by], c[by], is_long[by], block[by]
            edges = np.searchsorted(block, np.arange(buckets + 1))
            for d in range(buckets):
                lo, hi = edges[d], edges[d + 1]
                if hi > lo:
                    s, k = _runs(c[lo:hi])
                    out.append(_row(d, _BACK, c[lo:hi][s].tobytes(), k.astype(np.uint32).tobytes(), h[lo:hi].tobytes(),
                                    is_long[lo:hi].astype(np.uint8).tobytes()))
        return pa.Table.from_batches([_packed(out)])

    return run


def _prefixes(percent: int):
    """One block of classes: shared lists per class; classes with at least T of them and the lists to merge."""

    def run(table: pa.Table) -> pa.Table:
        sizes, names, hashes, flags = {}, [], [], []
        cols = [binaries(table.column(k)) for k in range(2, 6)]
        for kind, keys, counts, hs, fl in zip(table.column(1).to_pylist(), *cols):
            k = np.frombuffer(keys, np.uint64)
            if kind == _SIZES:
                sizes.update(zip(k.tolist(), np.frombuffer(counts, np.uint32).tolist()))
            else:
                names.append(np.repeat(k, np.frombuffer(counts, np.uint32)))
                hashes.append(np.frombuffer(hs, np.uint64))
                flags.append(np.frombuffer(fl, np.uint8))
        out = {"c": [], "n": [], "shared": [], "prefix": []}
        if hashes:
            c, h, f = np.concatenate(names), np.concatenate(hashes), np.concatenate(flags)
            by = np.lexsort((h, f, c))
            c, h = c[by], h[by]
            start, length = _runs(c)
            for s, k in zip(start.tolist(), length.tolist()):
                own = h[s: s + k]
                if k > 1:  # a list that one map task sent as long and another as short
                    _, at = np.unique(own, return_index=True)
                    own = own[np.sort(at)] if len(at) < k else own
                n = sizes[int(c[s])]
                t = need(n, percent)
                if len(own) >= t:
                    out["c"].append(int(c[s].astype(np.int64)))
                    out["n"].append(n)
                    out["shared"].append(np.sort(own).tobytes())
                    out["prefix"].append(own[: len(own) - t + 1].astype(np.int64))
        return pa.table({"c": pa.array(out["c"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                         "shared": pa.array(out["shared"], pa.binary()),
                         "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))})

    return run


def divide_skip(lists: list[np.ndarray], least: int, longest: int) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted id lists, with their counts.

    The ``longest`` (< least) longest lists are set aside; the others are
    heap-merged, ids with ``least - longest`` occurrences are probed in the
    long lists by binary search, longest last, until they cannot reach it.
    """
    longest = max(0, min(longest, least - 1, len(lists)))
    ordered = sorted(lists, key=len)
    short, long_lists = ordered[: len(lists) - longest], ordered[len(lists) - longest:]
    seen: list[int] = []
    count: list[int] = []
    last = -1
    for i in heapq.merge(*[x.tolist() for x in short]):
        if i == last:
            count[-1] += 1
        else:
            seen.append(i)
            count.append(1)
            last = i
    ids, found = np.array(seen, np.int64), np.array(count, np.int64)
    live = found >= least - longest
    ids, found = ids[live], found[live]
    for k, probed in enumerate(long_lists):
        if not len(ids):
            break
        at = np.searchsorted(probed, ids)
        found = found + (probed[np.minimum(at, len(probed) - 1)] == ids)
        live = found + (len(long_lists) - k - 1) >= least
        if not live.all():
            ids, found = ids[live], found[live]
    keep = found >= least
    return dict(zip(ids[keep].tolist(), found[keep].tolist()))


def search(query: np.ndarray, n: int, members: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the members whose Jaccard similarity with the query reaches the threshold."""
    whole = np.concatenate(members)
    who = np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = np.searchsorted(query, whole)
    hit = query[np.minimum(at, len(query) - 1)] == whole
    at, who = at[hit], who[hit]
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    start, length = _runs(at)
    lists = [who[s: s + k] for s, k in zip(start.tolist(), length.tolist())]
    # 100 * o >= percent * (n + m - o) for the smallest member bounds T from below
    least = int(max(-(-percent * (n + int(sizes.min())) // (100 + percent)), need(n, percent), 1))
    if len(lists) < least:
        return np.zeros(0, np.int64)
    got = divide_skip(lists, least, least - 1 - (least - 1) // 16)
    return np.array([m for m, o in got.items() if 100 * o >= percent * (n + int(sizes[m]) - o)], np.int64)


def _search_blocks(percent: int):
    """Several (leader, salt) blocks: the leader's row has m = leader."""

    def run(table: pa.Table) -> pa.Table:
        frame = {k: table.column(k).to_numpy() for k in ("leader", "salt", "m", "n")}
        shared = binaries(table.column("shared"))
        order = np.lexsort((frame["m"] != frame["leader"], frame["salt"], frame["leader"]))
        key = np.stack([frame["leader"], frame["salt"]], 1)[order]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, np.int64)
        a, b = [], []
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(order)]):
            rows = order[lo:hi]
            if hi - lo < 2:
                continue
            members = rows[1:]
            got = search(np.frombuffer(shared[rows[0]], np.uint64), int(frame["n"][rows[0]]),
                         [np.frombuffer(shared[r], np.uint64) for r in members], frame["n"][members], percent)
            a += [int(frame["leader"][rows[0]])] * len(got)
            b += frame["m"][members[got]].tolist() if len(got) else []
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (leader, m) whose sets reach the threshold, as (a, b)."""
    tasks = 4 * parts(pairs.sparkSession)
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("salts"))
    rows = (pairs.join(blocks, "leader").withColumn("salt", F.pmod(F.xxhash64("m", F.lit(7)), "salts").cast("int"))
            .select("leader", "salt", "m").join(sets.select(F.col("c").alias("m"), "n", "shared"), "m"))
    heads = (blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
             .join(sets.select(F.col("c").alias("leader"), "n", "shared"), "leader").withColumn("m", F.col("leader")))
    cols = ["leader", "salt", "m", "n", "shared"]
    return (rows.select(cols).unionByName(heads.select(cols))
            .withColumn("task", F.pmod(F.xxhash64("leader", "salt"), F.lit(tasks)))
            .groupBy("task").applyInArrow(lambda t: _search_blocks(percent)(t), "a long, b long"))


def _merge_lists(sets: DataFrame) -> DataFrame:
    """The lists to merge: a row per class and list, with the list before it in the class (``before``) and how many
    shared lists the class has from it on (``after``).

    Lists of one class are left out, and so are lists that all their members
    reach from one and the same list: whatever meets in them has met there.
    """
    rows = sets.select("c", "n", (F.octet_length("shared") / 8).cast("long").alias("shared"), "prefix", F.posexplode("prefix").alias("i", "h"))
    rows = rows.select("h", "c", "n", "shared", F.get("prefix", F.col("i") - 1).alias("before"), (F.col("shared") - F.col("i")).alias("after"))
    live = rows.groupBy("h").agg(F.count("*").alias("k"), F.count("before").alias("b"), F.min("before").alias("x"), F.max("before").alias("y"))
    live = live.where("k > 1 AND (b < k OR x <> y)").select("h")
    return stored(rows.join(live, "h", "left_semi"), "merge-lists")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75):
    """``(rows, links)``: each document's ``doc_id, n_shingles, c`` (class, null for an empty set) and links (a, b) of classes."""
    spark = docs.sparkSession
    buckets = parts(spark)
    src = same_type(docs, {doc_id: "long", text: "string"})
    lists, prefixes = _bucket_lists(buckets), _prefixes(percent)
    packed = stored(src.mapInArrow(_map_postings(n, buckets), _PACKED).groupBy("dest").applyInArrow(lambda t: lists(t), _PACKED), "lists")
    rows = packed.where(F.col("kind") == _DOCS).mapInArrow(_unpack_docs, "doc_id long, n_shingles long, c long")
    sets = stored(packed.where(F.col("kind") > _DOCS).groupBy("dest").applyInArrow(
        lambda t: prefixes(t), "c long, n long, shared binary, prefix array<long>"), "sets")
    merge = _merge_lists(sets)
    # the first list that two classes share: no list before it is shared, and what follows must suffice for the overlap
    able = f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND {100 + percent} * least(after, after2) >= {percent} * (n + n2)"
    links, tested = None, None
    for turn in range(LEADERS + 1):
        if turn:
            comp = components(links)
            merge = merge.drop("component").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn(
                "component", F.coalesce("component", "c"))
            live = merge.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
            merge = stored(merge.join(live, "h", "left_semi"), "merge-lists")
        if turn < LEADERS:
            best = F.col("shared") / F.col("n") if turn == 0 else F.lit(0)
            lead = merge.groupBy("h").agg(F.max_by(F.struct("c", "n", "shared"), F.struct(best, F.xxhash64("c", F.lit(turn)))).alias("l"))
            pairs = merge.join(lead, "h").where("c <> l.c").withColumns({"n2": F.col("l.n"), "after": F.col("shared"), "after2": F.col("l.shared")})
            pairs = pairs.where(able).select(F.col("l.c").alias("leader"), F.col("c").alias("m"))
        else:
            other = merge.select("h", *[F.col(k).alias(f"{k}2") for k in ("c", "n", "before", "after", "component")])
            pairs = merge.join(other, "h").where("component <> component2 AND c < c2 AND (before IS NULL OR before2 IS NULL OR before <> before2)")
            pairs = pairs.where(able).select(F.col("c").alias("leader"), F.col("c2").alias("m"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["leader", "m"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stored(_links(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
    return rows, links


def _unpack_docs(batches):
    for batch in batches:
        for key, null, name, size in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("keys", "counts", "hashes", "flags"))):
            size = np.frombuffer(size, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(key, np.int64), mask=np.frombuffer(null, np.uint8).astype(bool)), pa.array(size),
                pa.array(np.frombuffer(name, np.uint64).astype(np.int64), mask=size == 0)], ["doc_id", "n_shingles", "c"])


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (see the module text)."""
    rows, links = jaccard_classes(docs, doc_id, text, n, percent)
    comp = components(links)
    rows = rows.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    low = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("low"))
    return rows.join(low, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
