"""Sharding by a hierarchical weighted hash tree.

A topology names shards by region and rack and gives each a weight; an inner
node weighs what its shards weigh.  A key descends region, rack and shard: at
each level every child draws ``-ln(u) / weight`` with u from a 64-bit hash of
(child, key), and the smallest draw wins, so a child gets keys in proportion
to its weight.  A draw depends on the child's own name and weight only.  When
weights change inside one subtree, the draws of all others stay: keys move
only into or out of that subtree, and inside it only between changed children.

Law ``key``: the key and the topology decide; equal keys share a shard.
:func:`grow` adds a shard as a subtree of its own, so one more shard takes
rows only into itself.  All of it is built-in functions; nothing is
collected, and no group larger than one input split's share of a shard is
ever sorted.

Cases.  Null key: placed as one more key value.  Null text: size 1, CRC-32 0.
Empty text: the same.  Repeated rows: each keeps its row and slot.  Empty
table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import same_type, stored


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def grid(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards, ``per_rack`` in a rack and ``racks`` racks in a region."""
    return [Shard(f"region{k // (per_rack * racks)}", f"rack{k // per_rack}", k) for k in range(shards)]


def grow(topology: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The topology with one more shard, in a region and rack of its own."""
    k = max(s.shard for s in topology) + 1
    return [*topology, Shard(f"grown-region{k}", f"grown-rack{k}", k, weight)]


def _draw(key: Column, level: str, name: str, weight: float) -> Column:
    """``-ln(u) / weight``; u lies strictly between 0 and 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}/{name}"), key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def _pick(key: Column, level: str, children: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child with the smallest draw (ties: the earlier name)."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    names = sorted(children)
    best = F.array_min(F.array(*[F.struct(_draw(key, level, n, children[n][0]).alias("d"), F.lit(k).alias("k")) for k, n in enumerate(names)]))["k"]
    chosen = F.lit(None).cast("int")
    case = None
    for k, n in enumerate(names):
        case = F.when(best == k, children[n][1]) if case is None else case.when(best == k, children[n][1])
    return case.otherwise(chosen)


def shard_of(key: Column, topology: Sequence[Shard]) -> Column:
    """The shard (int) that the key descends to; shards of no weight get nothing."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in topology:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = {}
    for region, racks in tree.items():
        inner = {rack: (sum(s.weight for s in shards),
                        _pick(key, f"{region}/{rack}", {str(s.shard): (s.weight, F.lit(s.shard)) for s in shards}))
                 for rack, shards in racks.items()}
        regions[region] = (sum(w for w, _ in inner.values()), _pick(key, region, inner))
    return _pick(key, "", regions)


def place(docs: DataFrame, topology: Sequence[Shard], grown: Sequence[Shard] | None = None,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Slots are gapless from 0 in each shard: rows are counted by (shard, input
    split), the running count of the splits before gives each split's first
    slot, and rows are numbered inside their (shard, split) only.
    """
    grown = grow(topology) if grown is None else grown
    src = same_type(docs, {doc_id: "long", text: "string"})
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = stored(src.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(F.col(doc_id), topology).alias("shard"), shard_of(F.col(doc_id), grown).alias("grown_shard"),
        F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("at")), "shards")
    counts = rows.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "split").orderBy("at")
    return rows.withColumn("k", F.row_number().over(within) - 1).join(first, ["shard", "split"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), "grown_shard")
