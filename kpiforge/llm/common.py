"""Helpers the operators share: shared-folder tables, vectorised word hashing, components."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import checkpoint_dir

# ------------------------------------------------------------------ tables in the shared folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage through a folder that every executor shares: a lost
    executor costs a re-read, never a recomputation of what led here.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """How many ways keyed work is dealt: the session's shuffle partitions, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same_type(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Only the named columns, cast to the given types; extra columns of the input never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols.items()])


# ------------------------------------------------------------------ word hashing on Arrow buffers

_C = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
      0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]
MULTIPLIERS = np.array(_C, np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D  # odd, = 5 mod 8: its powers have the longest period mod 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0])
SLICE = (1 << 20) - 1  # bytes of text that are hashed at a time


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker: caches that any task may rebuild."""
    return sys.modules.setdefault("_kpiforge_worker", types.SimpleNamespace(state={})).state


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept up to a slice; a longer row has its own."""
    held = worker_state().get("powers")
    if held is None or len(held[0]) <= n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, SLICE) + 1, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64, out=p))
        held = out[0], out[1]
        if n <= SLICE:
            worker_state()["powers"] = held
    return held


def binaries(col) -> list:
    """Buffers of a binary column, without copies."""
    return [None if not v.is_valid else v.as_buffer() for chunk in (col.chunks if isinstance(col, pa.ChunkedArray) else [col]) for v in chunk]


def byte_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's bounds in them; null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[bounds[0]: bounds[-1]]
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE):
    """Consecutive row ranges of at most ``most`` bytes; a longer row stands alone."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def classes(space: str, fold: bool, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its kind (0 outside words, 1 in a word, 2 in a run of ASCII punctuation, if that is told apart)
    and its value in the hash (A-Z as a-z if ``fold``)."""
    kind = np.ones(256, np.uint8)
    if punctuation:
        kind[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("_")]] = 2
    kind[[ord(c) for c in space]] = 0
    value = _TABLE.copy()
    if fold:
        value[65:91] = value[97:123]
    return kind, value


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FOLDED = classes(SPACE, True)


def word_spans(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and one-past-last byte of every run of one kind, and the row each lies in; runs never cross rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = kinds[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[bounds] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial prefix sums mod 2**64, then mixed."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (position k holds words k .. k+n-1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * MULTIPLIERS[5] + words[k: k + m] * MULTIPLIERS[k % 5]
    return mix(out + np.uint64(n))


def hash_slices(col, table=FOLDED, most: int = SLICE):
    """Word hashes of a string column, a few megabytes at a time: first row, number of rows, hashes, each word's row."""
    data, bounds = byte_view(col)
    kinds, value = table
    for i, j in slices(bounds, most):
        part, edge = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
        starts, ends, rows = word_spans(part, edge, kinds)
        yield i, j - i, word_hashes(part, starts, ends, value), rows


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable for every node of ``edges(a, b)``: columns ``node, component``.

    Alternating large-star and small-star steps; every step is a grouped
    minimum with partial aggregation, so a hub's edges are reduced where they
    lie.  Labels and edges stay distributed; each round's edge table is
    written to the shared folder.
    """
    edges = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour points at the smallest of the neighbourhood
        large = edges.selectExpr("b AS a", "a AS v").join(low, "a").selectExpr("v AS a", "m AS b")
        large = large.unionByName(low.where("m < a").selectExpr("a", "m AS b")).where("a <> b").distinct()
        # small star: each smaller neighbour and the node itself point at the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("b AS a", "m AS b")
        nxt = stored(small.unionByName(least.selectExpr("a", "m AS b")).where("a <> b").distinct(), "edges")
        # done when no node points at two others and no target points on: one grouped pass
        ends = nxt.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            nxt.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ends = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out + into > 1")
        edges = nxt
        if not open_ends.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
