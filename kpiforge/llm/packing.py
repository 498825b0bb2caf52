"""Harmonic packing of token sequences.

``pack(docs)`` tokenises every text, appends the end id, cuts and packs it
into sequences of at most ``capacity`` ids.  Lengths fall into reciprocal
classes: class j holds pieces longer than capacity / (j + 1) and at most
capacity / j, and a bin of class j takes exactly j of them.  A bin is known
from a piece's rank in its class alone, so workers fill bins independently;
they only share how many pieces of each class the splits before them hold.

Little padding: a piece stays whole when it fills its place of capacity / j
up to one part in ``tolerance``; otherwise it is cut at capacity / (j + 1),
which fills a place of the next class exactly, and the short rest goes on.
The last, incomplete bin of each class (a number of pieces that depends on
the capacity alone, not on the input) is packed first-fit by falling length.

A sequence is padded to ``capacity`` unless its length is a power of two.

Cases.  Null or empty text: the end id alone.  Very long texts: tokenised a
run of white-space-separated words at a time, any number of pieces.  Repeated
rows: packed each.  Null ``doc_id``: kept.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import byte_view, classes, same_type, slices, stored, word_hashes, worker_state

WORDS = 500_000  # distinct words whose ids a worker keeps; beyond it starts anew
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, split int, at long"
#: 0: white space, which the tokenizer drops; 1: ASCII letters (it lower-cases them); 2: other ASCII; 3: never cut beside these
_GAPS = classes(" \t\n\r", True)
_KIND = np.where(_GAPS[0] == 0, 0, 2).astype(np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[128:] = 3
_KIND[ord("'")] = 3


def word_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that the tokenizer treats apart: words cut between ASCII letters and other ASCII characters, but whole
    beside apostrophes (contractions) and characters beyond ASCII, and wherever a special token could be written out."""
    kind = _KIND[data]
    if b"<|" in data.tobytes():
        kind = np.minimum(kind, 1)
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != 3) & (kind[:-1] != 3)
    space = kind == 0
    inner[1:-1] |= space[1:] != space[:-1]
    inner[0] = inner[-1] = True
    inner[bounds] = True
    at = np.flatnonzero(inner)
    starts, ends = at[:-1], at[1:]
    word = ~space[starts]
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


class WordIds:
    """Token ids of words and parts of words (:func:`word_parts`), by the tokenizer file; every distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == hashes, at, -1) if len(self.known) else np.full(len(hashes), -1)

    def learn(self, hashes: np.ndarray, words: list[str]):
        counts, parts = [], [self.ids]
        for k in range(0, len(words), 4096):  # an encoding weighs far more than its ids
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words[k: k + 4096], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
        count = np.concatenate(counts)
        first = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate(parts)
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, joined, and each row's bounds in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts, ends, rows = word_parts(data, bounds)
        hashes, where, back = np.unique(word_hashes(data, starts, ends, _GAPS[1]), return_index=True, return_inverse=True)
        new = self.find(hashes) < 0
        if new.any():
            if len(self.known) + int(new.sum()) > WORDS:
                self.forget()
                new[:] = True
            body = data.tobytes()
            self.learn(hashes[new], [body[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        at = self.find(hashes)[back] if len(hashes) else np.zeros(0, np.int64)
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[at] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(rows, np.arange(len(bounds)))]


def cut(length: int, capacity: int, tolerance: int = 64) -> list[tuple[int, int]]:
    """Pieces (length, class) of a run of ``length`` ids, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        place = capacity // j
        if (place - rest) * tolerance <= place:
            pieces.append((rest, j))
            break
        part = capacity // (j + 1)
        pieces.append((part, j + 1))
        rest -= part
    return pieces


def _pieces(path: str, end: int, capacity: int, tolerance: int):
    def run(batches):
        held = worker_state()
        split, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            words = held.get(path) or held.setdefault(path, WordIds(path))
            key, null = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
            data, bounds = byte_view(batch.column(1))
            for i, j in slices(bounds):
                ids, edge = words.encode(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i])
                out = []
                for r in range(j - i):
                    own = np.append(ids[edge[r]: edge[r + 1]], np.uint32(end)).astype("<u4")
                    body, start = own.tobytes(), 0
                    for length, c in cut(len(own), capacity, tolerance):
                        seen[c] = seen.get(c, -1) + 1
                        out.append((int(key[i + r]), bool(null[i + r]), start, length, zlib.crc32(body[4 * start: 4 * (start + length)]), len(own), c, split, seen[c]))
                        start += length
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(cols[0], np.int64), mask=np.array(cols[1])), *[pa.array(c, pa.int64()) for c in cols[2:6]],
                    *[pa.array(c, pa.int32()) for c in cols[6:8]], pa.array(cols[8], pa.int64())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "split", "at"])

    return run


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken by falling length."""
    room, bins, offsets = np.full(64, capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        b = int(np.argmax(room >= lengths[k]))
        if room[b] < lengths[k]:
            b = len(room)
            room = np.concatenate([room, np.full(len(room), capacity)])
        bins[k], offsets[k] = b, capacity - room[b]
        room[b] -= lengths[k]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 4096, tolerance: int = 64,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class``."""
    src = same_type(docs, {doc_id: "long", text: "string"})
    pieces = stored(src.mapInArrow(_pieces(tokenizer, end, capacity, tolerance), _PIECE), "pieces")
    counts = pieces.groupBy("class", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("class", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # one row per class (their number depends on the capacity alone): full bins, and the number of the first
    full = counts.groupBy("class").agg(F.expr("cast(floor(sum(n) / class) as long)").alias("bins"))
    order = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("base", F.coalesce(F.sum("bins").over(order), F.lit(0))).withColumn(
        "total", F.sum("bins").over(Window.partitionBy()))
    ranked = (pieces.join(first, ["class", "split"]).join(F.broadcast(full), "class")
              .withColumn("rank", F.col("first") + F.col("at")).withColumn("bin", F.expr("cast(floor(rank / class) as long)")))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    within = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = (ranked.where("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
             .withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(*cols, "sequence_id", "offset", "class"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("class", "ascending"), ("rank", "ascending")])
        bins, offsets = first_fit(table.column("length").to_numpy(), capacity)
        base = table.column("total").to_numpy()
        return table.select([*cols, "class"]).append_column("sequence_id", pa.array(base + bins)).append_column(
            "offset", pa.array(offsets)).select([*cols, "sequence_id", "offset", "class"])

    last = (ranked.where("bin >= bins").select(*cols, "class", "rank", "total").groupBy(F.lit(0).alias("one"))
            .applyInArrow(lambda t: rest(t.drop_columns(["one"]) if "one" in t.column_names else t), schema))
    return whole.unionByName(last)
