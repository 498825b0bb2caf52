"""Prefix trie of conversations that continue each other, with Count-min screening of prefix digests.

Every conversation c is rebuilt: the first h(c) turns of the conversation
``c - c % 5``, then its own turns after its first h(c).  A node is a distinct
sequence of first turns; it is reported under its smallest member, with its
parent, members, children, leaves below it, the bytes that sharing its subtree
saves, and a digest of the members that end there.

1. Turns become two 64-bit hashes and a length where they lie; texts never
   move.  Turns are dealt by range of (conversation, turn), so a conversation
   of any length is cut over tasks, and numbered by running counts: tasks count
   what they hold, and the ends of their ranges (two rows a task) say what each
   carries over (:func:`_running`).
2. The same scan over the rebuilt turns gives each prefix a 128-bit digest
   (two polynomials of the turns' hashes; carries combine like the counts do).
3. A Count-min sketch of all prefixes (two rows of cells that count to two,
   merged block by block, ``MOST_CELLS`` a row at most) is broadcast.  A prefix
   whose estimate is one is a singleton, and so are all longer ones of its
   conversation: that tail is emitted where it lies.  Only the rest is
   grouped, exactly; a sketch that is too full sends more there and changes
   nothing else.
4. Sums over subtrees need no walk: a conversation is the smallest member of
   its nodes from some depth on (it *owns* them), so a node's leaves, children
   and saved bytes are plain sums over its members, of what each owns or not.
   Groups are summed in the tasks before they move, so a first turn that a
   third of all conversations share is one row a task.
5. Ids of members that end at a node are joined in blocks of 4096 ids, and the
   blocks of a node are hashed as a stream, in order: SHA-256 has no parallel
   form, but a task holds one block at a time.

Cases.  Turns are ordered by turn (null first), then role, then a hash of the
text; repeated rows are turns of their own.  Null role or text: empty.  Rows
without a conversation id belong to no conversation and are left out.
Remainders of negative ids have the id's sign, as in SQL.  A conversation may
be left without turns: it ends at the root.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import MULTIPLIERS, mix, parts, same_type, stored

STRIDE, FOLDS = 5, 9  # c - c % STRIDE is the conversation c continues, crc32(c) % FOLDS how far
MOST_CELLS = 1 << 26  # of a row of the sketch; 16 MB are broadcast at most
PER_PREFIX = 2  # cells of a row for each prefix, at least, below that
BLOCK = 4096  # bytes of the sketch that are merged as one group's row
IDS = 12  # bits of ids that one block of ending members spans
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)  # odd
_KEY = ["depth", "p1", "p2"]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent mod 2**64 of every exponent."""
    out, square, left = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        with np.errstate(over="ignore"):
            square = square * square
        left = left >> np.uint64(1)
    return out


def _chained(base: int, t: np.ndarray, first: np.ndarray, carry: int, upto: int) -> np.ndarray:
    """Values of the polynomial p = p * base + t after every row, anew from each row ``first`` names; the rows before ``upto``
    go on from ``carry``."""
    n = len(t)
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * down[:n], dtype=np.uint64)])
    p = (total[1:] - total[first]) * up[:n]
    p[:upto] += np.uint64(carry) * up[1: upto + 1]
    return p


_SCANNED = ("conv_id long, t1 long, t2 long, size long, pos long, p1 long, p2 long, total long, part int, lead boolean, head boolean, "
            "tail boolean, last boolean")


def _local(batches):
    """Running counts, digests and lengths in the conversations of one range; marks the range's first conversation (lead), its
    first and last row (head, tail) and rows after which another conversation begins (last)."""
    part = TaskContext.get().partitionId()
    state, held, lead_id = None, None, None

    def out(cols, end, final):
        conv = cols["conv_id"]
        tail = np.zeros(len(conv), bool)
        tail[-1] = final
        cols = {**cols, "tail": tail, "last": np.append(conv[1:] != conv[:-1], end)}
        return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in cols.items()})

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        conv, size = batch.column("conv_id").to_numpy(), batch.column("size").to_numpy()
        t = [batch.column(c).to_numpy().view(np.uint64) for c in ("t1", "t2")]
        start = np.append(True, conv[1:] != conv[:-1])
        goes_on = state is not None and state[0] == conv[0]
        group = np.cumsum(start) - 1
        first = np.flatnonzero(start)[group]
        upto = int(np.searchsorted(group, 0, "right")) if goes_on else 0
        pos = np.arange(n) - first + 1
        sums = np.concatenate([[0], np.cumsum(size)])
        total = sums[1:] - sums[first]
        p = [_chained(b, t[k], first, state[3 + k] if goes_on else 0, upto) for k, b in enumerate(_BASES)]
        if goes_on:
            pos[:upto] += state[1]
            total[:upto] += state[2]
        head = np.zeros(n, bool)
        if lead_id is None:
            lead_id, head[0] = conv[0], True
        if held is not None:
            yield out(held, conv[0] != held["conv_id"][-1], False)
        held = {"conv_id": conv, "t1": t[0], "t2": t[1], "size": size, "pos": pos, "p1": p[0], "p2": p[1], "total": total,
                "part": np.full(n, part, np.int32), "lead": conv == lead_id, "head": head}
        state = conv[-1], int(pos[-1]), int(total[-1]), int(p[0][-1]), int(p[1][-1])
    if held is not None:
        yield out(held, True, True)


def _carries(rows: list) -> tuple[dict, set]:
    """What each range carries over from those before it (count, length, digests), and the ranges after whose last row the
    conversation goes on.  ``rows``: the end rows of all ranges."""
    ranges: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["conv_id"], r["pos"])):
        ranges.setdefault(r["part"], []).append(r)
    carried, going_on, state, before = {}, set(), None, None
    for part in sorted(ranges):
        head, tail = ranges[part][0], ranges[part][-1]
        if state is not None and state[0] == head["conv_id"]:
            carried[part] = state[1:]
            going_on.add(before)
        count, total, p = tail["pos"], tail["total"], [tail["p1"] % 2 ** 64, tail["p2"] % 2 ** 64]
        if part in carried and tail["lead"]:
            c = carried[part]
            p = [(x + y * pow(b, count, 1 << 64)) % 2 ** 64 for x, y, b in zip(p, c[2:], _BASES)]
            count, total = count + c[0], total + c[1]
        state, before = (tail["conv_id"], count, total, *p), part
    return carried, going_on


def _running(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, Callable]:
    """The scan of ``rows`` (conv_id, t1, t2, size and the columns of ``order``) by conversation, and what completes a batch of it:
    columns conv_id, t1, t2, size, pos, p (both digests), q (those before the row), total, last as arrays."""
    dealt = rows.repartitionByRange(parts(rows.sparkSession), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    scanned = stored(dealt.select("conv_id", "t1", "t2", "size").mapInArrow(_local, _SCANNED), name)
    # two rows of each range, whatever the ranges hold
    carried, going_on = _carries(scanned.where("head OR tail").select("part", "conv_id", "pos", "total", "p1", "p2", "lead").collect())

    def whole(batch) -> dict:
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        p = [col["p1"].view(np.uint64).copy(), col["p2"].view(np.uint64).copy()]
        pos, total, part, last = col["pos"].copy(), col["total"].copy(), col["part"], col["last"].copy()
        for k in np.unique(part):
            own = part == k
            if int(k) in going_on:
                last &= ~(own & col["tail"])
            if int(k) in carried:
                at = np.flatnonzero(own & col["lead"])
                c = carried[int(k)]
                for i, b in enumerate(_BASES):
                    p[i][at] += np.uint64(c[2 + i]) * _power(b, pos[at])
                pos[at] += c[0]
                total[at] += c[1]
        t = [col["t1"].view(np.uint64), col["t2"].view(np.uint64)]
        inverse = [np.uint64(pow(b, -1, 1 << 64)) for b in _BASES]
        q = [(x - y) * i for x, y, i in zip(p, t, inverse)]
        return {"conv_id": col["conv_id"], "t": t, "size": col["size"], "pos": pos, "p": p, "q": q, "total": total, "last": last}

    return scanned, whole


def h_of(conv_id):
    """How many turns of the conversation it continues a conversation starts with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % FOLDS


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    src = same_type(conversations, {conv_id: "long", turn: "long", role: "string", text: "string"})
    words = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    return src.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), words[0].alias("role"), F.xxhash64(F.lit(1), *words).alias("t1"),
        F.xxhash64(F.lit(2), *words).alias("t2"), F.octet_length(words[1]).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"))  # so that repeated rows can lie in several ranges


def _rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns of rebuilt conversations in order of (conv_id, seg, at), after a turn without text for the root."""
    scanned, whole = _running(_turns(conversations, conv_id, turn, role, text), ["turn", "role", "t1", "t2", "row"], "trie-turns")

    def run(batches):
        for batch in batches:
            c = whole(batch)
            yield pa.RecordBatch.from_arrays([pa.array(c["conv_id"]), pa.array(c["pos"]), pa.array(c["t"][0].view(np.int64)),
                                              pa.array(c["t"][1].view(np.int64)), pa.array(c["size"])], ["conv_id", "at", "t1", "t2", "size"])

    numbered = scanned.mapInArrow(run, "conv_id long, at long, t1 long, t2 long, size long")
    every = numbered.where("at = 1").select("conv_id")
    own = numbered.where(F.col("at") > h_of(F.col("conv_id"))).selectExpr("conv_id", "1 AS seg", "at", "t1", "t2", "size")
    start = numbered.where(F.col("at") < FOLDS).withColumnRenamed("conv_id", "base")
    first = every.select("conv_id", h_of(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("base")).where(
        "h > 0").join(start, "base").where("at <= h").selectExpr("conv_id", "0 AS seg", "at", "t1", "t2", "size")
    root = every.selectExpr("conv_id", "-1 AS seg", "0L AS at", "0L AS t1", "0L AS t2", "0L AS size")
    return stored(own.unionByName(first).unionByName(root), "trie-rebuilt")


# ------------------------------------------------------------------ Count-min screening


def _places(depth: np.ndarray, p: list, cells: int) -> list[np.ndarray]:
    """Cell of each prefix in both rows of the sketch (the second row's follow the first's)."""
    h = mix(p[0] * MULTIPLIERS[0] + mix(p[1] * MULTIPLIERS[1] + depth.astype(np.uint64)))
    mask = np.uint64(cells - 1)
    return [(h & mask).astype(np.int64), (mix(h + MULTIPLIERS[2]) & mask).astype(np.int64) + cells]


def _bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _screen(scanned: DataFrame, whole: Callable, cells: int) -> np.ndarray:
    """Bitmap of the cells that took two prefixes or more."""
    def run(batches):
        once, twice = np.zeros(2 * cells // 8, np.uint8), np.zeros(2 * cells // 8, np.uint8)
        for batch in batches:
            c = whole(batch)
            at, n = np.unique(np.concatenate(_places(c["pos"] - 1, c["p"], cells)), return_counts=True)
            more = at[(n > 1) | _bits(once, at)]
            np.bitwise_or.at(twice, more >> 3, np.uint8(1) << (more & 7).astype(np.uint8))
            np.bitwise_or.at(once, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        size = min(BLOCK, len(once))
        for k in np.flatnonzero(once.reshape(-1, size).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[k * size: (k + 1) * size].tobytes()], pa.binary()),
                                              pa.array([twice[k * size: (k + 1) * size].tobytes()], pa.binary())], ["block", "once", "twice"])

    def merge(table: pa.Table) -> pa.Table:  # one row for each task
        once = twice = None
        for a, b in zip(table.column("once"), table.column("twice")):
            a, b = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pa.table({"block": table.column("block").slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})

    out = np.zeros(2 * cells // 8, np.uint8)
    size = min(BLOCK, len(out))
    rows = scanned.mapInArrow(run, "block int, once binary, twice binary").groupBy("block").applyInArrow(merge, "block int, twice binary")
    for r in rows.collect():  # 2 * MOST_CELLS / 8 bytes at most
        out[r["block"] * size: (r["block"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    return out


SHARED, FIRST, TAIL = 0, 1, 2  # maybe shared; the first proven singleton of its conversation; a later one
_PREFIX = "conv_id long, depth long, size long, before long, ends boolean, p1 long, p2 long, q1 long, q2 long, kind int"


def prefixes(rebuilt: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """All prefixes of rebuilt conversations: digests, bytes before the last turn, whether it is the whole, and their kind."""
    scanned, whole = _running(rebuilt, ["seg", "at"], "trie-scan")
    n = scanned.count()
    cells = 8
    while cells < min(PER_PREFIX * n, most_cells):
        cells *= 2
    held = rebuilt.sparkSession.sparkContext.broadcast(_screen(scanned, whole, cells))

    def run(batches):
        before = None  # id, depth of the last row of the batch before, and whether it was proven a singleton
        for batch in batches:
            c = whole(batch)
            conv, depth = c["conv_id"], c["pos"] - 1
            a, b = _places(depth, c["p"], cells)
            alone = ~(_bits(held.value, a) & _bits(held.value, b))
            start = np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1))
            run_of = np.cumsum(start) - 1
            first = np.full(run_of[-1] + 1, len(conv))  # the first proven row of each run of rows
            np.minimum.at(first, run_of[alone], np.flatnonzero(alone))
            at = np.arange(len(conv))
            kind = np.where(at < first[run_of], SHARED, np.where(at == first[run_of], FIRST, TAIL)).astype(np.int32)
            if before is not None and before == (conv[0], depth[0] - 1, True):
                kind[run_of == 0] = TAIL
            before = conv[-1], depth[-1], bool(kind[-1] != SHARED)
            none = kind == TAIL
            digest = [pa.array(x.view(np.int64), mask=none) for x in (*c["p"], *c["q"])]
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), pa.array(c["size"]), pa.array(c["total"] - c["size"]),
                                              pa.array(c["last"]), *digest, pa.array(kind)],
                                             ["conv_id", "depth", "size", "before", "ends", "p1", "p2", "q1", "q2", "kind"])

    return stored(scanned.mapInArrow(run, _PREFIX), "trie-prefixes")


# ------------------------------------------------------------------ nodes


def _ends(shared: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of nodes where conversations end: their ids, ascending, hashed block by block."""
    blocks = shared.where("ends").groupBy(*_KEY, F.shiftright("conv_id", IDS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")

    def run(batches):
        key = state = None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own == key:
                    state.update(b"," + ids.encode())
                else:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = own, hashlib.sha256(ids.encode())
            yield rows(done)
        yield rows([(*key, state.hexdigest())] if key else [])

    def rows(done):
        return pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), d)) for d in done], pa.schema(
            [("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())]))

    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _sha(text):
    return F.sha2(text.cast("binary"), 256)


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         most_cells: int = MOST_CELLS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    rows = prefixes(_rebuilt(conversations, conv_id, turn, role, text), most_cells)
    shared, alone = rows.where(F.col("kind") == SHARED), rows.where(F.col("kind") == FIRST)
    nodes = stored(shared.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("ends").alias("leaf"), F.first("before").alias("before"),
        F.first("q1").alias("q1"), F.first("q2").alias("q2")), "trie-nodes")
    # the depth from which a conversation owns its nodes (past its end: none), the bytes above it, and whether it owns a leaf
    owns = nodes.select("conv_id", "depth", "before", "leaf").unionByName(
        alone.select("conv_id", "depth", "before", F.lit(True).alias("leaf"))).unionByName(
        shared.where("ends").selectExpr("conv_id", "depth + 1 AS depth", "before + size AS before", "false AS leaf")).groupBy("conv_id").agg(
        F.min(F.struct("depth", "before")).alias("own"), F.max("leaf").alias("leaf"))
    sums = shared.select("conv_id", *_KEY, "before", "ends").join(owns, "conv_id").groupBy(*_KEY).agg(
        F.sum(F.expr("if(NOT ends AND own.depth <= depth + 1, 1L, 0L)")).alias("n_children"), F.sum(F.expr("if(leaf, 1L, 0L)")).alias("n_leaves"),
        F.sum(F.expr("if(own.depth > depth, own.before - before, 0L)")).alias("saved_tokens"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id")
    nothing = _sha(F.lit(""))
    grouped = nodes.join(sums, _KEY).join(_ends(shared), _KEY, "left").join(above, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    def single(df, parent):
        return df.select("conv_id", "depth", parent, F.lit(1).cast("long").alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"),
                         F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                         F.when(F.col("ends"), _sha(F.col("conv_id").cast("string"))).otherwise(nothing).alias("ends_sha256"))

    tails = single(rows.where(F.col("kind") == TAIL), F.col("conv_id").alias("parent_conv_id"))
    return grouped.unionByName(single(alone.join(above, ["depth", "q1", "q2"], "left"), parent)).unionByName(tails)
