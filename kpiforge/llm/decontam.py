"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: words are runs of letters and
digits (A-Z as a-z), a run of numbers becomes ``<num>``, a unit after a number
``<unit>``, a run of capitalised words inside a sentence ``<name>``.  Windows
of ``window`` template words are joined by hash; a document's windows that
meet an item's windows are aligned with them, and an item leaks into a
document when

* the windows met cover at least ``coverage`` of the item's windows, or as
  many as a passage of ``PASSAGE`` template words has, and
* slots are consistent: over all aligned slots an item's value goes with one
  value in the document and the other way round (at most one aligned slot in
  ten may break this), so an exact copy passes with every slot unchanged and
  a re-parameterised question with every value replaced throughout, while
  texts that share phrases around unrelated figures do not.

Both are tested over all windows met in the document and, where the slots of
these do not agree, for every occurrence by itself: windows on one diagonal
(document position minus item position) and those in order before and after it
on diagonals at most half an item away.  The item leaks if one of them passes,
so a worksheet with several versions of a question holds it, and an item of
parallel sentences is not held against itself.

Windows of plain words (A-Z as a-z, no placeholders) are joined as well, so a
copy in other case, or inside a sentence where its first word looks like a
name, is found: an item leaks if an occurrence holds enough of its windows of
plain words.  Where templates met there and their slots did not agree, the
share of ``coverage`` is asked for, a passage does not do.  Such a leak has
its windows of plain words in ``n_windows`` and ``coverage``, and no slots.

The benchmark's windows are the query set, searched against all documents:
items are dealt into blocks of at most ``BLOCK_WINDOWS`` windows, and each
block travels to the tasks, which scan whole texts; documents never move.

Cases.  Null or empty texts, and items without a word, match nothing.  Items
shorter than a window are one window of their own length, and need at least
``SHORTEST`` template words or, as plain words, that many of those: items of
fewer plain words match nothing.  Items with equal texts each get their rows;
documents that repeat each get theirs.  Null ids are kept.  Empty tables: no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import MULTIPLIERS, byte_view, classes, mix, ngram_hashes, same_type, slices, word_hashes, word_spans

WINDOW = 8
SHORTEST = 5
COVERAGE = 0.5
PASSAGE = 13  # so many words of a long item are a leak too
BLOCK_WINDOWS = 2_000_000  # windows of items (about 60 bytes each) that travel to the tasks at once

# fixed values: words that count as units when they follow a number
UNITS = """m cm mm km kg g mg l ml lb lbs oz ft inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres pound pounds ounce ounces
gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years percent
dollar dollars cent cents euro euros usd eur gbp mph kmh degree degrees volt volts watt watts kw kb mb gb""".split()

_KINDS, _VALUE = classes("", True)
_KINDS = np.where([(48 <= b < 58) or (65 <= b < 91) or (97 <= b < 123) or b >= 128 for b in range(256)], 1, 0).astype(np.uint8)
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_STOP = np.array([chr(b) in ".!?:;\n\r\"" for b in range(256)])


def _hash_of(words: list[str]) -> np.ndarray:
    data, bounds = byte_view(pa.array(words, pa.string()))
    return word_hashes(data, bounds[:-1], bounds[1:], _VALUE)


_UNIT = np.sort(_hash_of(UNITS))
NUM, UNIT, NAME = (np.uint64(k) for k in mix(np.array([11, 12, 13], np.uint64)))


def plain_words(data: np.ndarray, bounds: np.ndarray):
    """Words of all rows as they are, A-Z as a-z: hash, row, first byte, end byte."""
    starts, ends, rows = word_spans(data, bounds, _KINDS)
    return word_hashes(data, starts, ends, _VALUE), rows, starts, ends


def templates(data: np.ndarray, hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Template words of all rows from their plain words: hash, value hash of slots (0 for literal words), row, first byte, end byte."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    number = digits[ends] > digits[starts]
    opens = np.ones(len(starts), bool)  # first of its row or of a sentence
    opens[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    capital = _UPPER[data[starts]]
    second = np.minimum(starts + 1, len(data) - 1)
    name = capital & ~opens & ~number & ((ends - starts == 1) | ~_UPPER[data[second]])
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[:-1] & ~opens[1:]
    unit = follows & ~number & np.isin(hashes, _UNIT)
    kind = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, np.uint64(0))))
    slot = kind != 0
    # a run of one kind of slot is one template word; its value is the hash of the run
    joins = np.zeros(len(starts), bool)
    joins[1:] = slot[1:] & (kind[1:] == kind[:-1]) & (rows[1:] == rows[:-1]) & ~(unit[1:])
    joins[1:] &= ~(opens[1:] & ~number[1:])
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(starts)) - 1
    turn = np.arange(len(starts)) - np.repeat(first, last - first + 1)
    values = np.add.reduceat(mix(hashes + turn.astype(np.uint64) * MULTIPLIERS[3]), first)
    words = np.where(slot[first], kind[first], hashes[first])
    return words, np.where(slot[first], values, np.uint64(0)), rows[first], starts[first], ends[last]


class Windows:
    """Windows of the words of a block's items, by size: sorted hash, item, position."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, items: int, window: int):
        self.first = np.searchsorted(rows, np.arange(items + 1))
        length = np.diff(self.first)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.count = np.where(length >= window, length - window + 1, np.where(length >= SHORTEST, 1, 0))
        hashes, item, at = {}, {}, {}
        for k in np.flatnonzero(self.count).tolist():
            w = min(window, int(length[k]))
            h = ngram_hashes(words[self.first[k]: self.first[k + 1]], w)
            hashes.setdefault(w, []).append(h)
            item.setdefault(w, []).append(np.full(len(h), k))
            at.setdefault(w, []).append(np.arange(len(h)))
        for w in hashes:
            h = np.concatenate(hashes[w])
            order = np.argsort(h, kind="stable")
            self.sizes[w] = h[order], np.concatenate(item[w])[order], np.concatenate(at[w])[order]

    def met(self, words: np.ndarray, rows: np.ndarray, coverage: float):
        """Per row and item that meet in enough windows: row, item, window size, windows needed, hits (document word, window)."""
        hit_d, hit_i, hit_q, hit_w = [], [], [], []
        for w, (known, item, at) in self.sizes.items():
            h = ngram_hashes(words, w)
            if not len(h):
                continue
            whole = rows[: len(h)] == rows[w - 1:]
            lo = np.searchsorted(known, h)
            pos = np.flatnonzero(whole & (known[np.minimum(lo, len(known) - 1)] == h))
            lo, hi = lo[pos], np.searchsorted(known, h[pos], "right")
            n = hi - lo
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hit_d.append(np.repeat(pos, n))
            hit_i.append(item[k])
            hit_q.append(at[k])
            hit_w.append(np.full(len(k), w))
        if not hit_d or not sum(map(len, hit_d)):
            return
        d, i, q, w = (np.concatenate(x) for x in (hit_d, hit_i, hit_q, hit_w))
        order = np.lexsort((d, i, rows[d]))
        d, i, q, w = d[order], i[order], q[order], w[order]
        r = rows[d]
        start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])]))
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(d)]):
            k, size = int(i[lo]), int(w[lo])
            need = min(coverage * self.count[k], max(PASSAGE - size + 1, 1))
            if len(np.unique(q[lo:hi])) >= need:
                yield int(r[lo]), k, size, need, d[lo:hi], q[lo:hi]


class Items:
    """A block of benchmark items, ready to be met by windows of templates and of plain words."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW):
        data, bounds = byte_view(pa.array(texts, pa.string()))
        plain = plain_words(data, bounds)
        self.words, self.values, rows, _, _ = templates(data, *plain)
        self.ids = ids
        self.templates = Windows(self.words, rows, len(ids), window)
        self.plain = Windows(plain[0], plain[1], len(ids), window)


def consistent(item_values: np.ndarray, doc_values: np.ndarray) -> tuple[int, int, int]:
    """Aligned slots, how many of them changed value, and how many break the one-to-one relation."""
    if not len(item_values):
        return 0, 0, 0
    pairs, n = np.unique(np.stack([item_values, doc_values], 1), axis=0, return_counts=True)
    bad = 0
    for side in (0, 1):
        by = np.lexsort((-n, pairs[:, side]))
        same = pairs[by, side]
        best = np.concatenate([[True], same[1:] != same[:-1]])
        bad = max(bad, int(n[by][~best].sum()))
    return len(item_values), int((item_values != doc_values).sum()), bad


def occurrences(d: np.ndarray, q: np.ndarray, size: int, length: int, need: float):
    """Hits (window q of an item at document word d) of each occurrence of the item with at least ``need`` windows: the
    diagonal with most hits first, joined by hits of near diagonals whose words lie before or after in both texts."""
    order = np.lexsort((q, d - q))
    d, q = d[order], q[order]
    diagonal = d - q
    first = np.flatnonzero(np.concatenate([[True], diagonal[1:] != diagonal[:-1]]))
    count = np.diff(np.append(first, len(d)))
    reach, free = max(length // 2, 1), np.ones(len(d), bool)
    for s in np.argsort(-count, kind="stable").tolist():
        at = int(diagonal[first[s]])
        lo, hi = np.searchsorted(diagonal, [at - reach, at + reach + 1])
        if hi - lo < need or not free[first[s]: first[s] + count[s]].any():
            continue
        near = np.flatnonzero(free[lo:hi]) + lo
        chain = near[diagonal[near] == at]
        near = near[diagonal[near] != at]
        while len(near):
            have = chain[np.argsort(q[chain], kind="stable")]
            k = np.searchsorted(q[have], q[near], "right")
            before, after = have[np.maximum(k - 1, 0)], have[np.minimum(k, len(have) - 1)]
            fits = (k == 0) | ((q[before] + size <= q[near]) & (d[before] + size <= d[near]))
            fits &= (k == len(have)) | ((q[near] + size <= q[after]) & (d[near] + size <= d[after]))
            near = near[fits]
            if len(near):
                lines, n = np.unique(diagonal[near], return_counts=True)
                best = diagonal[near] == lines[n.argmax()]
                chain, near = np.concatenate([chain, near[best]]), near[~best]
        free[chain] = False
        if len(chain) >= need:
            yield order[chain]


def find_leaks(data: np.ndarray, bounds: np.ndarray, items: Items, coverage: float = COVERAGE):
    """(row, item, windows met, share of the item's windows, slots, changed slots, first byte, end byte) of every leak into the rows."""
    plain = plain_words(data, bounds)
    words, values, rows, starts, ends = templates(data, *plain)
    found, refused = set(), {}
    for r, k, size, need, d, q in items.templates.met(words, rows, coverage):
        offset = items.templates.first[k]
        length = int(items.templates.first[k + 1] - offset)
        step, whole = np.arange(size), True
        for own in itertools.chain([np.arange(len(d))], occurrences(d, q, size, length, need)):
            a, b = (d[own, None] + step).ravel(), (q[own, None] + step).ravel()
            aligned = np.unique(a * (length + 1) + b, return_index=True)[1]
            a, b = a[aligned], b[aligned] + offset
            slot = values[a] != 0
            slots, changed, bad = consistent(items.values[b[slot]], values[a[slot]])
            first, end = int(starts[a.min()]), int(ends[a.max()])
            if 10 * bad <= slots:
                met = len(np.unique(q[own]))
                yield r, k, met, met / items.templates.count[k], slots, changed, first, end
                found.add((r, k))
                break
            if not whole:
                refused.setdefault((r, k), []).append((first, end))
            whole = False
    words, rows, starts, ends = plain
    for r, k, size, need, d, q in items.plain.met(words, rows, coverage):
        if (r, k) in found:
            continue
        length = int(items.plain.first[k + 1] - items.plain.first[k])
        for own in occurrences(d, q, size, length, need):
            first, end, met = int(starts[d[own].min()]), int(ends[d[own].max() + size - 1]), len(np.unique(q[own]))
            judged = any(first < e and f < end for f, e in refused.get((r, k), ()))
            if met >= (coverage * items.plain.count[k] if judged else need):
                yield r, k, met, met / items.plain.count[k], 0, 0, first, end
                break


def _scan(items: Items, coverage: float):
    def run(batches):
        for batch in batches:
            data, bounds = byte_view(batch.column(1))
            keys = batch.column(0)
            out = []
            for i, j in slices(bounds):
                for row, k, met, share, slots, changed, _, _ in find_leaks(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i], items, coverage):
                    out.append((i + row, items.ids[k], met, float(share), slots, changed))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3]), *[pa.array(c, pa.int64()) for c in cols[4:]]],
                    ["doc_id", "item_id", "n_windows", "coverage", "n_slots", "n_changed"])

    return run


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, most: int = BLOCK_WINDOWS):
    """The benchmark in blocks of items of at most about ``most`` windows each, one block in memory at a time."""
    own = same_type(benchmark, {item_id: "long", text: "string"}).where(F.length(text) > 0)
    words = own.agg(F.sum(F.octet_length(text))).first()[0] or 0  # a window starts at a word, so bytes / 2 bounds their number
    blocks = -(-words // (2 * most)) or 1
    spread = F.pmod(F.xxhash64(item_id, text), F.lit(blocks))
    for k in range(blocks):
        rows = own.where(spread == k).collect()
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows], window)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that leaks into it: ``doc_id, item_id, n_windows, coverage, n_slots, n_changed``."""
    schema = "doc_id long, item_id long, n_windows long, coverage double, n_slots long, n_changed long"
    src = same_type(docs, {doc_id: "long", text: "string"})
    found = [src.mapInArrow(_scan(items, coverage), schema) for items in item_blocks(benchmark, item_id, item_text, window)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that any item leaks into; all columns stay, nothing is shuffled."""
    at, schema = docs.columns.index(text), docs.schema
    for items in item_blocks(benchmark, item_id, item_text, window):

        def run(batches, items=items):
            for batch in batches:
                data, bounds = byte_view(batch.column(at).cast(pa.string()))
                keep = np.ones(batch.num_rows, bool)
                for i, j in slices(bounds):
                    for row, *_ in find_leaks(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i], items, coverage):
                        keep[i + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
