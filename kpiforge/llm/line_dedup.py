"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: first by their number of words,
then by their leading ``DEPTH`` words, words with a digit counting as a
variable field.  In a leaf, a line joins the template that equals it in at
least ``SIMILAR`` of the words after the leading ones; where they differ the
template gets a variable field.  A template that occurs in at least
``min_docs`` documents recurs; its lines are dropped from all of them but the
first (the smallest ``doc_id``), so a passage, notice or copied document stays
once in the corpus.  Lines without a word are no templates and stay.

A map task parses its documents into a tree of its own, so a line that a third
of all documents share leaves the task as one template with a count; templates
of all tasks then meet leaf by leaf.  Equal lines (but for variable fields)
share a template wherever they are; lines that differ elsewhere meet by the
tree's greedy rule, in the order of their hashes, in the task or the leaf.

Cases.  ``n_dropped`` counts whole lines.  Null or empty text: unchanged.  A null ``doc_id`` comes after all
others as first document.  Rows equal in id and text count each, and are
treated alike.  Other columns pass through.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kpiforge.llm.common import MULTIPLIERS, _powers, byte_view, classes, mix, parts, slices, stored, word_hashes, word_spans

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 3
LONG, ANCHOR = 50, 16  # words of a passage inside a line, at least, and of the runs that name it
REACH = (LONG - ANCHOR) // 2  # words that every run has before its anchor or after it
FLUSH = 1 << 23  # bytes of words and lines that one tree of a map task holds
VARIABLE, ANY = 1, 0  # a word with a digit; a field that varies inside a template
_EXACT = classes("\x20\x09\x0a\x0b\x0c\x0d", False)
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LAST = np.iinfo(np.int64).max
_PACKED = "dest int, kind int, ids binary, sizes binary, words binary"
_SCHEMA = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])
_TEMPLATES, _LINES = 0, 1
_RUN = np.dtype([("run", "<i8"), ("s", "<i4"), ("e", "<i4")])


def _words(col):
    """Per slice of a text column: bytes, row bounds, first row, and per word its first and end byte, row, hash and line number;
    the first word of each line."""
    data, bounds = byte_view(col)
    for i, j in slices(bounds):
        part, edge = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
        starts, ends, rows = word_spans(part, edge, _EXACT[0])
        if not len(starts):
            continue
        hashes = word_hashes(part, starts, ends, _EXACT[1])
        breaks = np.flatnonzero(part == 10)
        passed = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1))[: len(starts)]
        number = passed - np.searchsorted(breaks, edge)[rows]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])]))
        yield part, edge, i, starts, ends, rows, hashes, number, first


def parse(col):
    """Per slice of a text column: words (32 bits each) and, per line with a word, its first word, length, leaf, hash, row and number."""
    for part, _, i, starts, _, rows, hashes, number, first in _words(col):
        words = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 2)
        words[np.searchsorted(starts, np.flatnonzero(_DIGIT[part]), "right") - 1] = VARIABLE
        length = np.diff(np.append(first, len(starts)))
        at = np.arange(len(starts)) - np.repeat(first, length)
        mixed = mix(words.astype(np.uint64) * MULTIPLIERS[0] + (at + 1).astype(np.uint64) * MULTIPLIERS[1])
        size = length.astype(np.uint64) * MULTIPLIERS[2]
        leaf = mix(np.add.reduceat(np.where(at < DEPTH, mixed, np.uint64(0)), first) + size)
        whole = mix(np.add.reduceat(mixed, first) + size)
        yield words, first, length, leaf, whole, rows[first] + i, number[first]


FEW = 64  # lines of a leaf that are compared with each of its templates


def grow_leaf(lines: list[np.ndarray], depth: int = DEPTH, similar: float = SIMILAR) -> tuple[np.ndarray, list[np.ndarray]]:
    """Template number of each line (equally long, same leading words), taken in order, and the templates.

    A line that may differ from its template in d of the words after the
    leading ones agrees with it in at least one of any d + 1 places.  A leaf of
    many lines lists its templates by their words in the d + 1 places where its
    lines vary most, and a line is compared with those it finds there only; the
    template it joins is the same.
    """
    size = len(lines[0])
    table, n, of = np.zeros((4, size), np.uint32), 0, np.zeros(len(lines), np.int64)
    rest = max(size - depth, 0)
    least = int(np.ceil(similar * rest - 1e-9))
    listed = None
    if len(lines) > FEW and least > 0:
        words = np.stack(lines)[:, depth:]
        varied = np.array([len(np.unique(words[:, k])) for k in range(rest)])
        places = np.sort(np.argsort(-varied, kind="stable")[: rest - least + 1]) + depth
        listed = [(int(k), {}) for k in places]
    for k, line in enumerate(lines):
        if n:
            if listed is None:
                near, rows = None, table[:n]
            else:
                near = sorted({t for at, by in listed for t in by.get(int(line[at]), ())})
                rows = table[near]
            same = (rows[:, depth:] == line[depth:]).sum(1)
            best = int(same.argmax()) if len(same) else -1
            if best >= 0 and same[best] >= similar * rest:
                best = best if near is None else near[best]
                of[k] = best
                table[best][table[best] != line] = ANY
                continue
        if n == len(table):
            table = np.concatenate([table, np.zeros_like(table)])
        table[n], of[k] = line, n
        for at, by in listed or ():
            by.setdefault(int(line[at]), []).append(n)
        n += 1
    return of, list(table[:n])


def _row(dest, kind, ids, sizes=b"", words=b""):
    return int(dest), kind, bytes(ids), bytes(sizes), bytes(words)


def _packed(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of pieces, one piece after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def _tree(leaf: np.ndarray, whole: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template of each distinct line of a tree (words from ``start``, so many each), and the templates: words and lengths."""
    if not len(leaf):
        return np.zeros(0, np.int64), words[:0], length[:0]
    order = np.lexsort((whole, leaf))
    low = np.flatnonzero(np.concatenate([[True], leaf[order][1:] != leaf[order][:-1]]))
    size = np.diff(np.append(low, len(order)))
    alone = order[low[size == 1]]
    of, out, lengths, n = np.zeros(len(leaf), np.int64), [words[_spread(start[alone], length[alone])]], [length[alone]], len(alone)
    of[alone] = np.arange(n)
    for lo, count in zip(low[size > 1].tolist(), size[size > 1].tolist()):
        own = order[lo: lo + count]
        k, found = grow_leaf([words[x: x + y] for x, y in zip(start[own].tolist(), length[own].tolist())])
        of[own] = k + n
        out += found
        lengths.append(np.full(len(found), len(found[0]), np.int64))
        n += len(found)
    return of, np.concatenate(out), np.concatenate(lengths)


def _first_of(rank: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Smallest rank of each of n groups."""
    low = np.full(n, _LAST)
    np.minimum.at(low, of, rank)
    return low


def _parse_docs(buckets: int):
    def run(batches):
        split, made = TaskContext.get().partitionId(), 0
        docs, lines, held = [], [], 0

        def flush():
            nonlocal made
            ids, marks = (np.concatenate(x) for x in zip(*docs))
            if lines:
                leaf, whole, row, number, length, words = (np.concatenate([x[k] for x in lines]) for k in range(6))
                start = np.cumsum(length) - length
                hashes, where, back = np.unique(whole, return_index=True, return_inverse=True)
                of, templates, size = _tree(leaf[where], hashes, words, start[where], length[where])
                of = of[back]
                count = np.bincount(np.unique(of * len(ids) + row) // len(ids), minlength=len(size))
                order = np.lexsort((marks, ids))
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                low = order[_first_of(rank[row], of, len(size))]
                name = ((split << 36) + made + np.arange(len(size))).astype(np.int64)
                made += len(size)
                leaf_of = np.zeros(len(size), np.uint64)
                leaf_of[of] = leaf
                dest = (leaf_of % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(dest, kind="stable")
                templates = templates[_spread((np.cumsum(size) - size)[order], size[order])]
                dest, size = dest[order], size[order]
                table = np.stack([leaf_of.view(np.int64), name, count, ids[low], marks[low]], 1)[order]
                own = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1], [True]]))
                at = np.concatenate([[0], np.cumsum(size)])
                for lo, hi in zip(own[:-1], own[1:]):
                    yield _row(dest[lo], _TEMPLATES, table[lo:hi].tobytes(), size[lo:hi].tobytes(), templates[at[lo]: at[hi]].tobytes())
                yield _row(made % buckets, _LINES, np.stack([ids[row], marks[row], number, name[of]], 1).tobytes())
            docs.clear()
            lines.clear()

        base = 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_LAST))
            marks = np.asarray(batch.column(1))
            docs.append((ids, marks))
            for words, first, length, leaf, whole, row, number in parse(batch.column(2)):
                lines.append((leaf, whole, row + base, number, length, words))
                held += 4 * len(words) + 64 * len(first)
            base += batch.num_rows
            if held >= FLUSH:
                yield _packed(list(flush()))
                base, held = 0, 0
        if docs:
            yield _packed(list(flush()))

    return run


def _join_trees(min_docs: int):
    """One bucket of leaves: templates of all tasks that are alike become one; those that recur name their first document."""

    def run(table: pa.Table) -> pa.Table:
        out, heads, sizes, words = [], [], [], []
        for dest, kind, ids, size, vectors in zip(*(table.column(k).to_pylist() for k in range(5))):
            if kind == _LINES:
                out.append((dest, kind, ids, b"", b""))
                continue
            heads.append(np.frombuffer(ids, np.int64).reshape(-1, 5))
            sizes.append(np.frombuffer(size, np.int64))
            words.append(np.frombuffer(vectors, np.uint32))
        if heads:
            head, length, words = np.concatenate(heads), np.concatenate(sizes), np.concatenate(words)
            start = np.cumsum(length) - length
            leaf = head[:, 0].copy().view(np.uint64)
            # leaves that cannot reach the count need no comparison
            _, at = np.unique(leaf, return_inverse=True)
            able = np.bincount(at, weights=head[:, 2])[at] >= min_docs
            head, leaf, start, length = head[able], leaf[able], start[able], length[able]
            if len(head):
                words = words[_spread(start, length)]
                start = np.cumsum(length) - length
                at = np.arange(len(words)) - np.repeat(start, length)
                whole = np.add.reduceat(mix(words.astype(np.uint64) * MULTIPLIERS[0] + (at + 1).astype(np.uint64) * MULTIPLIERS[1]), start) ^ leaf
                hashes, where, back = np.unique(whole, return_index=True, return_inverse=True)
                of, _, size = _tree(leaf[where], hashes, words, start[where], length[where])
                of = of[back]
                count = np.bincount(of, weights=head[:, 2], minlength=len(size)).astype(np.int64)
                order = np.lexsort((head[:, 4], head[:, 3]))
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                low = order[_first_of(rank, of, len(size))]
                again = count[of] >= min_docs
                out.append(_row(0, _TEMPLATES, np.stack([head[:, 1], head[low[of], 3], head[low[of], 4]], 1)[again].tobytes()))
        return pa.Table.from_batches([_packed(out)])

    return run


def _unpack(width: int):
    def run(batches):
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                rows = np.frombuffer(ids, np.int64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(width)], [f"x{k}" for k in range(width)])

    return run


def _long_runs(col):
    """Per slice with a run of ``LONG`` words in a line: row bounds, first row, per word its first and end byte, row and line number;
    the first word of each such run; a function that hashes the words from some on, so many each; hashes of all runs of ``ANCHOR`` words."""
    for _, edge, i, starts, ends, rows, hashes, number, first in _words(col):
        size = np.diff(np.append(first, len(starts)))
        at = np.flatnonzero(np.repeat(first + size, size) >= np.arange(len(starts)) + LONG)
        if not len(at):
            continue
        up, down = _powers(len(hashes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

        def hashed(k, n, total=total, down=down):
            return mix((total[k + n] - total[k]) * down[k])

        yield edge, i, starts, ends, rows, number, at, hashed, mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: len(hashes) - ANCHOR + 1])


def _lowest(low: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The smallest of the anchors inside each run of ``LONG`` words, and the first place where it stands."""
    at, span, most = np.arange(len(low)) if places else None, 1, LONG - ANCHOR + 1
    while span < most:  # minimum over 2, 4, ... and at last ``most`` anchors
        step = min(span, most - span)
        if places:
            at = np.where(low[:-step] <= low[step:], at[:-step], at[step:])
        low, span = np.minimum(low[:-step], low[step:]), span + step
    return low.view(np.int64), at


def _names(batches):
    for batch in batches:
        for _, i, _, _, rows, _, at, _, anchors in _long_runs(batch.column(1)):
            name, row = _lowest(anchors)[0][at], rows[at] + i
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(name[new])], ["k", "name"])


def _segments(batches):
    """Runs of the names listed with each document, but for those in lines that go, as segments.

    A run holds ``REACH`` words on one side of its anchor; with the anchor they are its closer name.  Consecutive runs of a closer name
    are a segment: named, hashed as a whole, and packed run by run (hash, first and end byte).
    """
    for batch in batches:
        listed = np.unique(np.asarray(batch.column(3).flatten()))
        gone = batch.column(4)
        flags, bounds = np.asarray(gone.flatten().fill_null(False)), np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(gone), 0)))])
        for edge, i, starts, ends, rows, number, at, hashed, anchors in _long_runs(batch.column(2)):
            name, anchor = (x[at] for x in _lowest(anchors, True))
            place = bounds[rows[at] + i] + number[at]
            goes = place < bounds[rows[at] + i + 1]
            goes[goes] = flags[place[goes]]
            own = (listed[np.minimum(np.searchsorted(listed, name), len(listed) - 1)] == name) & ~goes
            at, anchor = at[own], anchor[own]
            if not len(at):
                continue
            anchor -= np.where(anchor - at >= REACH, REACH, 0)
            close, row = hashed(anchor, ANCHOR + REACH).view(np.int64), rows[at]
            new = np.flatnonzero(np.concatenate([[True], (close[1:] != close[:-1]) | (at[1:] != at[:-1] + 1) | (number[at[1:]] != number[at[:-1]]) | (row[1:] != row[:-1])]))
            last = np.append(new[1:], len(at)) - 1
            size = (at[last] - at[new] + LONG).astype(np.uint64)
            first, end = (starts[at] - edge[row]).astype(np.int32), (ends[at + LONG - 1] - edge[row]).astype(np.int32)
            runs = np.empty(len(at), _RUN)
            runs["run"], runs["s"], runs["e"] = hashed(at, LONG).view(np.int64), first, end
            packed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.append(new, len(at)) * _RUN.itemsize).astype(np.int32)), pa.py_buffer(runs)])
            whole = mix(hashed(at[new], LONG + last - new) + size * MULTIPLIERS[2]).view(np.int64)
            of = pa.array(row[new] + i)
            yield pa.RecordBatch.from_arrays([pa.array(close[new]), pa.array(whole), batch.column(0).take(of), batch.column(1).take(of),
                                              pa.array(first[new]), pa.array(end[last]), packed], ["name", "seg", "x0", "x1", "s", "e", "runs"])


def _unpack_runs(batches):
    for batch in batches:
        data = batch.column(2)
        runs = np.frombuffer(b"".join(data.to_pylist()), _RUN)
        of = pa.array(np.repeat(np.arange(len(data)), np.asarray(pc.binary_length(data)) // _RUN.itemsize))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(runs["run"])), batch.column(0).take(of), batch.column(1).take(of),
                                          pa.array(np.ascontiguousarray(runs["s"])), pa.array(np.ascontiguousarray(runs["e"]))], ["run", "x0", "x1", "s", "e"])


def _merge(batches):
    """Overlapping runs as one cut."""
    for batch in batches:
        runs = batch.column(2)
        row = np.asarray(pc.list_parent_indices(runs)).astype(np.int64)
        flat = runs.flatten()
        s, e = (np.asarray(x).astype(np.int64) + (row << 32) for x in flat.flatten())
        order = np.argsort(s, kind="stable")
        row, s, e = row[order], s[order], np.maximum.accumulate(e[order])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool))
        cuts = np.stack([s[new], e[np.append(new[1:], len(s)) - 1]], 1).reshape(-1) & 0xFFFFFFFF if len(s) else np.zeros(0, np.int64)
        bounds = 2 * np.searchsorted(row[new], np.arange(batch.num_rows + 1))
        out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cuts.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["x0", "x1", "cuts"])


def repeated_passages(src: DataFrame, gone: DataFrame) -> DataFrame:
    """Passages to cut from documents ``i, m, t``: ``x0, x1`` and ``cuts`` (first byte, end byte, first byte, ...); ``gone``: lines that go.

    Equal runs have equal names and closer names.  A segment goes as a whole from all documents but the first that has it; where a
    closer name has several different segments, the runs of each one's first document are compared one by one.
    """
    src = src.select(F.coalesce("i", F.lit(_LAST)).alias("x0"), F.col("m").alias("x1"), "t")
    key, doc = F.xxhash64("x0", "x1"), F.struct("x0", "x1")
    names = stored(src.select(key.alias("k"), "t").mapInArrow(_names, "k long, name long"), "passage-names")
    shared = names.groupBy("name").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("name")
    listed = names.join(shared, "name").groupBy("k").agg(F.collect_set("name").alias("names"))
    listed = stored(listed.join(gone.select(key.alias("k"), "gone"), "k", "left"), "passage-lists")
    segments = stored(src.withColumn("k", key).join(listed.hint("shuffle_hash"), "k").select("x0", "x1", "t", "names", "gone").mapInArrow(
        _segments, "name long, seg long, x0 long, x1 long, s int, e int, runs binary"), "passage-segments")
    # written: each join then has exchanges of its own on both sides, and Spark cuts a passage that very many documents share
    alike = stored(segments.groupBy("name", "seg").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")), "passage-alike")
    closer = stored(alike.groupBy("name").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), (F.min("seg") != F.max("seg")).alias("differ")).where(
        "a <> b").select("name", "differ"), "passage-closer")
    alike = stored(alike.join(closer, "name").where("differ OR lo <> hi").select("name", "seg", "lo", "differ"), "passage-lowest")
    later = F.expr("x0 <> lo.x0 OR x1 <> lo.x1")
    found = stored(segments.join(alike, ["name", "seg"]).where(later | F.col("differ")).select(
        "x0", "x1", "s", "e", F.when(~later, F.col("runs")).alias("runs")), "passage-found")
    runs = stored(found.where("runs IS NOT NULL").select("x0", "x1", "runs").mapInArrow(
        _unpack_runs, "run long, x0 long, x1 long, s int, e int"), "passage-runs")
    first = runs.groupBy("run").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo <> hi")
    first = stored(first.select("run", "lo"), "passage-first")
    again = found.where("runs IS NULL").select("x0", "x1", "s", "e").unionByName(runs.join(first, "run").where(later).select("x0", "x1", "s", "e"))
    return again.groupBy("x0", "x1").agg(F.collect_set(F.struct("s", "e")).alias("runs")).mapInArrow(_merge, "x0 long, x1 long, cuts array<int>")


def _without(text: str, gone: list, cuts: list) -> tuple[str, int]:
    """A text without lines that go and without cuts, and how many lines went."""
    kept, at, k, dropped = [], 0, 0, 0
    for n, line in enumerate(text.encode().split(b"\n")):
        end, pieces, low = at + len(line), [], 0
        while k < len(cuts) and cuts[k] < end:
            pieces.append(line[low: cuts[k] - at])
            low, k = cuts[k + 1] - at, k + 2
        if n < len(gone) and gone[n]:
            dropped += 1
        elif not pieces:
            kept.append(line)
        else:
            pieces.append(line[low:])
            left = [p for p in (x.strip(b" \t\r\x0b\x0c") for x in pieces[1:-1]) if p]
            ends = [pieces[0].rstrip(b" \t\r\x0b\x0c"), *left, pieces[-1].lstrip(b" \t\r\x0b\x0c")]
            rest = b" ".join(p for p in ends if p)
            if rest.strip():
                kept.append(rest)
            else:
                dropped += 1
        at = end + 1
    return b"\n".join(kept).decode(), dropped


def _apply(at: int, width: int):
    """Columns of documents, the text (column ``at``) without its lines and passages, number of lines, and of lines dropped."""

    def run(batches):
        for batch in batches:
            cols, dropped = batch.columns, np.zeros(batch.num_rows, np.int64)
            touched = np.asarray(pc.or_(cols[width + 1].is_valid(), cols[width + 2].is_valid()))
            if touched.any():
                rows = pa.array(np.flatnonzero(touched))
                new = [_without(t, g or [], c or []) for t, g, c in zip(*(cols[k].take(rows).to_pylist() for k in (at, width + 1, width + 2)))]
                cols[at] = pc.replace_with_mask(cols[at], pa.array(touched), pa.array([t for t, _ in new], cols[at].type))
                dropped[touched] = [n for _, n in new]
            yield pa.RecordBatch.from_arrays([*cols[: width + 1], pa.array(dropped)], [str(k) for k in range(width + 2)])

    return run


def _mask(batches):
    """Line numbers to drop as one flag per line, up to the last of them."""
    for batch in batches:
        flags = []
        for lines in batch.column(2).to_pylist():
            mask = np.zeros(max(lines) + 1, bool)
            mask[lines] = True
            flags.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.list_(pa.bool_()))], ["x0", "x1", "gone"])


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.xxhash64(body).alias("m"), body.alias("t"))


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines to drop: ``x0`` (doc_id, the largest long for null), ``x1`` (xxhash64 of the text), ``gone`` (a flag per line)."""
    buckets, src = parts(docs.sparkSession), _source(docs, doc_id, text)
    join = _join_trees(min_docs)
    packed = stored(src.mapInArrow(_parse_docs(buckets), _PACKED).groupBy("dest").applyInArrow(lambda t: join(t), _PACKED), "templates")
    lines = packed.where(F.col("kind") == _LINES).select("ids").mapInArrow(_unpack(4), "x0 long, x1 long, x2 long, x3 long")
    again = packed.where(F.col("kind") == _TEMPLATES).select("ids").mapInArrow(_unpack(3), "x0 long, x1 long, x2 long").toDF("x3", "keep0", "keep1")
    gone = lines.join(again, "x3").where("x0 <> keep0 OR x1 <> keep1").groupBy("x0", "x1").agg(F.collect_set("x2").alias("lines"))
    return gone.mapInArrow(_mask, "x0 long, x1 long, gone array<boolean>")


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without its recurring lines and repeated passages, and two more columns:
    ``n_lines, n_dropped``."""
    gone = stored(recurring_lines(docs, doc_id, text, min_docs), "recurring-lines")
    cuts = repeated_passages(_source(docs, doc_id, text), gone)
    changes = stored(gone.join(cuts, ["x0", "x1"], "full"), "changes")
    own, body = F.col(f"d.`{doc_id}`"), F.col(f"d.`{text}`").cast("string")
    key = (F.coalesce(own.cast("long"), F.lit(_LAST)) == F.col("g.x0")) & (F.xxhash64(body) == F.col("g.x1"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n", -1))).cast("long").alias("n_lines")
    others = [body.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    # hashed, not sorted: only the small side is held, and texts are dealt once whatever the sizes
    joined = docs.alias("d").join(changes.hint("shuffle_hash").alias("g"), key, "left").select(*others, n_lines, "g.gone", "g.cuts")
    schema = StructType([*joined.schema.fields[: len(docs.columns) + 1], StructField("n_dropped", LongType())])
    return joined.mapInArrow(_apply(docs.columns.index(text), len(docs.columns)), schema)
