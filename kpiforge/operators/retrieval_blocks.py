"""Steps of retrieval inside a task: texts packed to blocks of words, terms by bucket of tokens, and scores of one block of
documents against one block of queries.  Spark deals the blocks; every step holds a bounded number of terms.

A block of texts is one row: ``ids``, the texts of each (``parts``, null: one each), their words as numbers into ``vocab``.  Terms
(tokens, their documents and counts) are made from it where they are needed, always in the same order, and are not stored.

Cases.  A null id is an id of its own while terms are counted.  Texts come lower-cased; null has no tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from kpiforge.functions.text import TOKEN_PATTERN

CHARS = 1 << 23   # bytes of texts in a block (64 more for each text); a longer text stands alone
FLUSH = 1 << 21   # values packed at once
ROWS = 1 << 17    # terms of a batch of rows
CHUNK_DOCS, CHUNK_QUERIES, PAIRS = 2048, 1024, 1 << 22  # of one table of scores; products of rare tokens added at once
DENSE, COMMON = 1024, 1 / 512  # tokens multiplied as a matrix at most, and the share of (query, document) pairs that hold one, at least
POSTINGS, NORMS, QUERIES, PAIRED = 0, 1, 2, 3
DEALT = "bucket int, block long, n int, toks binary, lens binary, dfs binary"  # n tokens of a block (null: of the index) in a bucket
_IN_WORD = np.array([bool(re.fullmatch(TOKEN_PATTERN, chr(b))) for b in range(128)] + [False] * 128)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks_schema(kind: str) -> str:
    return f"block long, ids array<{kind}>, parts binary, lens binary, words binary, vocab array<string>"


def _bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends in the bytes of all (from 0), and these."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return (ends - ends[0], data[ends[0]: ends[-1]]) if len(ends) else (np.zeros(1, np.int64), data[:0])


def _strings(data, lens: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(ends), pa.py_buffer(data))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and the words."""
    ends, data = _bytes(texts.fill_null(""))
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(first)
    return np.diff(np.searchsorted(first, ends)), _strings(data[inside], np.flatnonzero(last) - first + 1)


def _sliced(batches):
    """Tables of rows with about ``CHARS`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        col = batch.column(1)
        if pa.types.is_list(col.type):
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(pc.list_flatten(col)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            upto = upto[np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))]
        else:
            upto = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        upto, lo = upto + 64 * np.arange(1, len(upto) + 1), 0
        while lo < len(upto):
            before = int(upto[lo - 1]) if lo else 0
            hi = int(np.searchsorted(upto, before + CHARS - size, "right"))
            hi = lo + 1 if hi <= lo and not held else hi
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(upto[hi - 1]) - before
                lo = hi
            if lo < len(upto):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack_words(first: int = 0):
    """``doc_id, text`` (or a list of texts) -> blocks, numbered from ``first``."""

    def run(batches):
        number = first + (TaskContext.get().partitionId() << 24)
        for made, table in enumerate(_sliced(batches)):
            ids, col, parts = _whole(table.column(0)), _whole(table.column(1)), None
            if pa.types.is_list(col.type):
                parts = _narrow(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)).tobytes()
                col = pc.list_flatten(col)
            lens, words = _words(col)
            code, vocab = _encoded(words)
            order = np.asarray(pc.array_sort_indices(vocab))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield _block_row(number + made, ids, parts, lens, rank[code], vocab.take(pa.array(order)))

    return run


def _block_row(block: int, ids: pa.Array, parts, lens: np.ndarray, words: np.ndarray, vocab: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([parts], pa.binary()),
         pa.array([_narrow(lens).tobytes()], pa.binary()), pa.array([_narrow(words).tobytes()], pa.binary()),
         pa.ListArray.from_arrays(pa.array([0, len(vocab)], pa.int32()), vocab.cast(pa.string()))],
        ["block", "ids", "parts", "lens", "words", "vocab"])


@dataclass
class Terms:
    """Terms of a block, in the order of tokens: numbers of token and document, how often it comes, and tokens of each document."""

    toks: pa.Array
    hashes: np.ndarray  # of the tokens' bytes
    code: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    n_tok: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.code, minlength=len(self.toks))


def _runs(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys ``value * n + document``: the value and the document of each different one, and how often it comes."""
    key, count = np.unique(key, return_counts=True)
    return key // n, key % n, count


def _rows(batch):
    """Rows of blocks: ``lens``, ``words`` and ``parts`` as numbers, ``vocab`` and ``ids`` as arrays."""
    for k in range(batch.num_rows):
        own = batch.slice(k, 1)
        ids = _whole(pc.list_flatten(own.column("ids")))
        parts, lens, words = (own.column(c)[0].as_py() for c in ("parts", "lens", "words"))
        parts = np.ones(len(ids), np.int64) if parts is None else _wide(parts, np.int64(len(ids)))
        lens = _wide(lens, parts.sum())
        yield own, ids, parts, lens, _wide(words, lens), _whole(pc.list_flatten(own.column("vocab")))


def terms_of(parts: np.ndarray, lens: np.ndarray, words: np.ndarray, vocab: pa.Array) -> Terms:
    """Unigrams and pairs of neighbours within a text."""
    n, size = max(len(parts), 1), max(len(vocab), 1)
    of_text = np.repeat(np.arange(len(parts)), parts)
    n_tok = np.bincount(of_text, lens + np.maximum(lens - 1, 0), len(parts)).astype(np.int64)
    text = np.repeat(np.arange(len(lens)), lens)
    doc, inside = of_text[text], np.flatnonzero(text[1:] == text[:-1])
    pair, names = words[inside] * size + words[inside + 1], None
    if size * size * n >= 1 << 62:
        names, pair = np.unique(pair, return_inverse=True)
    code, at, count = _runs(words * n + doc, n)
    pair, pair_at, pair_count = _runs(pair * n + doc[inside], n)
    new = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
    pairs = pair[new] if names is None else names[pair[new]]
    left, right = pairs // size, pairs % size
    toks = pa.concat_arrays([vocab, pc.binary_join_element_wise(vocab.take(pa.array(left)), vocab.take(pa.array(right)), "_")])
    hashes, power = _hashes(vocab)
    hashes = np.concatenate([hashes, hashes[left] + power[np.diff(_bytes(vocab)[0])[left]] * (hashes[right] + np.uint64(ord("_") + 1))])
    code, at, count = (np.concatenate(x) for x in ((code, len(vocab) + np.cumsum(new) - 1), (at, pair_at), (count, pair_count)))
    if pc.any(pc.match_substring(vocab, "_")).as_py():
        # a word may read as a pair of others does
        same, toks = _encoded(toks)
        hashes = _hashes(toks)[0]
        key, back = np.unique(same[code] * n + at, return_inverse=True)
        code, at, count = key // n, key % n, np.bincount(back, count).astype(np.int64)
    return Terms(toks, hashes, code, at, count, n_tok)


def _hashes(toks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial of each token's bytes, and the powers it is made of: that of a token joined with another follows from theirs."""
    ends, data = _bytes(toks)
    lens = np.diff(ends)
    power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, _ODD), dtype=np.uint64)
    if not len(toks):
        return np.zeros(0, np.uint64), power
    return np.add.reduceat(power[np.arange(len(data)) - np.repeat(ends[:-1], lens)] * (data.astype(np.uint64) + np.uint64(1)), ends[:-1]), power


def _in_buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of tokens by bucket, and the bucket of each in that order."""
    for shift in (33, 29):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * _ODD
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(_narrow(bucket), kind="stable")
    return order, bucket[order]


def deal_tokens(buckets: int, sign: int = 1):
    """Blocks -> a row (``DEALT``) for each bucket of tokens that one holds: its tokens there, and in how many of its documents each is."""

    def run(batches):
        for batch in batches:
            for own, _, *rest in _rows(batch):
                terms = terms_of(*rest)
                if not len(terms.toks):
                    continue
                order, bucket = _in_buckets(terms.hashes, buckets)
                ends, data = _bytes(terms.toks.take(pa.array(order)))
                lens, sizes = np.diff(ends), terms.sizes[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(order)]
                rows = [(int(bucket[lo]), hi - lo, data[ends[lo]: ends[hi]].tobytes(), _narrow(lens[lo:hi]).tobytes(), _narrow(sizes[lo:hi]).tobytes())
                        for lo, hi in zip(cuts, cuts[1:])]
                cols = list(zip(*rows))
                block = own.column("block")[0].as_py() if sign > 0 else -1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.binary()) for c in cols[2:]]], ["bucket", "block", "n", "toks", "lens", "dfs"])

    return run


def _dealt(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens and numbers of rows of ``DEALT``, and how many each has."""
    n = table["n"].to_numpy()
    lens, dfs = (np.concatenate([_wide(x, k) for x, k in zip(table[c].to_pylist(), n)] or [np.zeros(0, np.int64)]) for c in ("lens", "dfs"))
    return _strings(b"".join(table["toks"].to_pylist()), lens), dfs, n


def _dealt_back(bucket: int, blocks: list, parts: list, names, dfs: np.ndarray) -> pa.Table:
    """A row for each block's numbers, and if ``names`` are given one with these tokens and ``dfs``."""
    rows = [(bucket, b, len(x), None, None, _narrow(x).tobytes()) for b, x in zip(blocks, parts)]
    if names is not None and len(names):
        ends, data = _bytes(names)
        rows.append((bucket, None, len(names), data.tobytes(), _narrow(np.diff(ends)).tobytes(), _narrow(dfs).tobytes()))
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "block", "n", "toks", "lens", "dfs"])


def count_bucket(back: bool):
    """All tokens of a bucket -> their document frequencies, and if ``back`` these for each block.  Rows without a block add
    frequencies that were counted before; those of block -1 take theirs away."""

    def run(table: pa.Table) -> pa.Table:
        toks, dfs, n = _dealt(table)
        blocks = table["block"].to_pylist()
        code, names = _encoded(toks)
        total = np.bincount(code, dfs * np.repeat([-1 if b == -1 else 1 for b in blocks], n), len(names)).astype(np.int64)
        parts = np.split(total[code], np.cumsum(n)[:-1]) if back else []
        if not total.all():
            names, total = names.take(pa.array(np.flatnonzero(total))), total[total != 0]
        return _dealt_back(table["bucket"][0].as_py(), blocks if back else [], parts, names, total)

    return run


def find_in_bucket(table: pa.Table) -> pa.Table:
    """Document frequencies that the index knows (else 0) of each block's tokens of a bucket."""
    asked = pc.is_valid(table["block"])
    toks, _, n = _dealt(table.filter(asked))
    names, dfs, _ = _dealt(table.filter(pc.invert(asked)))
    at = pc.index_in(toks, value_set=names)
    found = np.where(np.asarray(at.is_valid()), np.concatenate([dfs, [0]])[np.asarray(at.fill_null(len(dfs)))], 0)
    return _dealt_back(table["bucket"][0].as_py(), table.filter(asked)["block"].to_pylist(), np.split(found, np.cumsum(n)[:-1]) if len(n) else [], None, dfs)


def list_tokens(batches):
    """``DEALT`` -> ``tok, df``."""
    for batch in batches:
        for k in range(batch.num_rows):
            toks, dfs, _ = _dealt(pa.Table.from_batches([batch.slice(k, 1)]))
            for lo in range(0, len(toks), ROWS):
                yield pa.RecordBatch.from_arrays([toks.slice(lo, ROWS).cast(pa.string()), pa.array(dfs[lo: lo + ROWS])], ["tok", "df"])


def list_terms(batches):
    """Blocks -> ``doc_id, tok, c, n_tok``, one row per token of a document, in the order of tokens for each block."""
    for batch in batches:
        for _, ids, *rest in _rows(batch):
            t = terms_of(*rest)
            for lo in range(0, len(t.code), ROWS):
                code, doc, count = (x[lo: lo + ROWS] for x in (t.code, t.doc, t.count))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), t.toks.take(pa.array(code)), pa.array(count.astype(np.int32)), pa.array(t.n_tok[doc].astype(np.int32))],
                    ["doc_id", "tok", "c", "n_tok"])


def keep_places(batches):
    """Blocks with ``places`` -> blocks of the documents there alone."""
    for batch in batches:
        for own, ids, parts, lens, words, vocab in _rows(batch):
            there = np.zeros(len(ids), bool)
            there[np.asarray(_whole(pc.list_flatten(own.column("places"))))] = True
            texts = np.repeat(there, parts)
            used, words = np.unique(words[np.repeat(texts, lens)], return_inverse=True)
            block = own.column("block")[0].as_py()
            of_texts = None if own.column("parts")[0].as_py() is None else _narrow(parts[there]).tobytes()
            yield _block_row(block, ids.filter(pa.array(there)), of_texts, lens[texts], words, vocab.take(pa.array(used)))


def _block_with_dfs(table: pa.Table, buckets: int):
    """The ids and terms of a block, and what came back for each token."""
    _, ids, *rest = next(_rows(table.filter(pc.is_valid(table["ids"])).combine_chunks()))
    terms = terms_of(*rest)
    back = table.filter(pc.is_valid(table["bucket"])).sort_by("bucket")
    dfs = np.zeros(len(terms.toks), np.int64)
    if back.num_rows:
        dfs[_in_buckets(terms.hashes, buckets)[0]] = np.concatenate([_wide(x, n) for x, n in zip(back["dfs"].to_pylist(), back["n"].to_numpy())])
    return ids, terms, dfs


def block_norms(buckets: int, n_docs: int):
    """A block and its tokens' document frequencies -> the norm of each of its documents, in their order."""

    def run(table: pa.Table) -> pa.Table:
        ids, t, dfs = _block_with_dfs(table, buckets)
        w = t.count * (np.log((n_docs + 1) / (dfs + 1)) + 1)[t.code]
        norm = np.sqrt(np.bincount(t.doc, w * w, len(ids))) / np.maximum(t.n_tok, 1)
        return pa.table([table["block"].slice(0, 1), pa.array([norm.tolist()], pa.list_(pa.float64()))], ["block", "norms"])

    return run


def block_vectors(buckets: int, n_docs: int):
    """A block of queries -> its known tokens and, by query, their normalised weights times idf."""

    def run(table: pa.Table) -> pa.Table:
        ids, t, dfs = _block_with_dfs(table, buckets)
        idf = np.log((n_docs + 1) / (dfs + 1)) + 1
        own = dfs[t.code] > 0
        code, row, w = t.code[own], t.doc[own], (t.count * idf[t.code])[own]
        norm = np.sqrt(np.bincount(row, w * w, max(len(ids), 1)))
        used, place = np.unique(code, return_inverse=True)
        ends, data = _bytes(t.toks.take(pa.array(used)))
        value = w / norm[row] * idf[code]
        return pa.table(
            [pa.array([int(table["block"][0].as_py())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(used)], pa.int32()),
             *[pa.array([x.tobytes()], pa.binary()) for x in (data, _narrow(np.diff(ends)), row.astype(np.int32), place.astype(np.int32), value)]],
            ["qblock", "qids", "qn", "qtoks", "qlens", "qrow", "qcode", "qw"])

    return run


def _gathered(batches, most: int):
    """Batches put together to about ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _encoded(col) -> tuple[np.ndarray, pa.Array]:
    """Number of each value among the distinct ones (null is one of them), and these."""
    codes = _whole(col).dictionary_encode(null_encoding="encode")
    return np.asarray(codes.indices).astype(np.int64), codes.dictionary


def _numbers(parts, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, kind) for p in parts] or [np.zeros(0, kind)])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _wide(x: bytes, sizes: np.ndarray) -> np.ndarray:
    """Numbers from as many bytes each as they were narrowed to."""
    if not x:
        return np.zeros(0, np.int64)
    return np.frombuffer(x, f"u{len(x) // int(sizes.sum())}").astype(np.int64)


def pack_rows(kind: int):
    """``block, id[, t], value`` -> packed rows of each block: ids, and for each value its id's place, its ``t`` and itself."""

    def run(batches):
        for table in _gathered(batches, FLUSH):
            block = np.asarray(_whole(table.column(0)))
            row, ids = _encoded(table.column(1))
            t = np.asarray(_whole(table.column(2))) if table.num_columns > 3 else np.zeros(len(row), np.int64)
            value = np.asarray(_whole(table.column(table.num_columns - 1)))
            order = np.lexsort((t, row, block))
            cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            for lo, hi in zip(cuts, cuts[1:]):
                own = order[lo:hi]
                there, at = np.unique(row[own], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[own[0]])], pa.int32()), pa.array([kind], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), ids.take(pa.array(there))),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), t[own].astype(np.int64), value[own].astype(np.float64))]],
                    ["block", "kind", "ids", "row", "t", "w"])

    return run


def _unpacked(rows: pa.Table, ids: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Place of each value's id among the distinct ids, these, and the values' ``t`` and ``w``."""
    code, distinct = _encoded(pc.list_flatten(rows[ids]))
    first = np.cumsum([0, *pc.list_value_length(rows[ids]).to_pylist()])
    row = np.concatenate([code[np.frombuffer(r, np.int32) + lo] for r, lo in zip(rows["row"].to_pylist(), first)] or [np.zeros(0, np.int64)])
    return row, distinct, _numbers(rows["t"].to_pylist(), np.int64), _numbers(rows["w"].to_pylist(), np.float64)


def _add_rare(score: np.ndarray, doc, t, w, start, rows, weights, place_of=None) -> None:
    """Add to ``score`` (query, document) the products of terms ``doc, t, w`` with the queries' terms, which lie by token from ``start``;
    ``place_of``: a query's row of ``score``, below 0 for none."""
    n = start[t + 1] - start[t]
    own = np.flatnonzero(n)
    doc, first, w, n = doc[own], start[t[own]], w[own], n[own]
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        many = n[lo:hi]
        at = np.arange(many.sum()) + np.repeat(first[lo:hi] - (np.cumsum(many) - many), many)
        query, of_doc, value = rows[at], np.repeat(doc[lo:hi], many), np.repeat(w[lo:hi], many) * weights[at]
        if place_of is not None:
            query = place_of[query]
            own = query >= 0
            query, of_doc, value = query[own], of_doc[own], value[own]
        score += np.bincount(query * score.shape[1] + of_doc, value, score.size).reshape(score.shape)
        lo = hi


def best_of_blocks(k: int, digits: int):
    """The ``k`` best documents of one block for each query of one block: ``qid, doc_id, score``; ties by id."""

    def run(batches):
        known = {}  # the last block of documents and of queries
        for batch in batches:
            for own, ids, *rest in _rows(batch):
                block, asked = (own.column(c)[0].as_py() for c in ("block", "qblock"))
                if known.get("block") != block:
                    known |= {"block": block, "terms": terms_of(*rest), "ids": _in_order(ids)}
                if known.get("asked") != asked:
                    q = [own.column(c)[0].as_py() for c in ("qtoks", "qlens", "qn", "qrow", "qcode", "qw")]
                    known |= {"asked": asked, "toks": _strings(q[0], _wide(q[1], np.int64(q[2]))), "query": [
                        np.frombuffer(x, kind) for x, kind in zip(q[3:], (np.int32, np.int32, np.float64))]}
                qids = _whole(pc.list_flatten(own.column("qids")))
                norm = np.asarray(_whole(pc.list_flatten(own.column("norms"))))
                yield _best_of_block(known["terms"], *known["ids"], norm, known["toks"], qids, *known["query"], k, digits)

    return run


def _in_order(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids in their order, and the place of each there: of equal scores the lower number comes first.  A null id is no document: -1."""
    order = pc.array_sort_indices(ids)
    place = np.empty(len(ids), np.int64)
    place[np.asarray(order)] = np.arange(len(ids))
    place[np.asarray(ids.is_null())] = -1
    return ids.take(order), place


def _best_of_block(terms: Terms, ids: pa.Array, place: np.ndarray, norm: np.ndarray, toks: pa.Array, qids: pa.Array, query: np.ndarray, qt: np.ndarray,
                   qw: np.ndarray, k: int, digits: int) -> pa.RecordBatch:
    at = pc.index_in(terms.toks.cast(toks.type), value_set=toks)
    both = np.asarray(at.is_valid())
    name = np.full(len(toks), -1)
    there = np.asarray(at.fill_null(0))
    name[there[both]] = np.arange(both.sum())
    names = np.flatnonzero(name >= 0)
    number = np.where(both, name[there] if len(toks) else 0, -1)
    own = (number[terms.code] >= 0) & (place[terms.doc] >= 0)
    doc, dt = terms.doc[own], number[terms.code[own]]
    dw = terms.count[own] / terms.n_tok[doc] / norm[doc]
    doc = place[doc]
    qt = name[qt]
    own = qt >= 0
    query, qt, qw = query[own].astype(np.int64), qt[own], qw[own]
    nd, nq = len(ids), len(qids)
    share = np.bincount(dt, minlength=len(names)) / max(nd, 1) * (np.bincount(qt, minlength=len(names)) / max(nq, 1))
    common = np.argsort(-share, kind="stable")[:DENSE]
    common = common[share[common] >= COMMON]
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    parts = []
    for lo in range(0, nq, CHUNK_QUERIES):
        own = np.flatnonzero((query >= lo) & (query < lo + CHUNK_QUERIES))
        n = min(CHUNK_QUERIES, nq - lo)
        row, t, w = query[own] - lo, qt[own], qw[own]
        often = column[t] >= 0
        dense = np.zeros((n, len(common)))
        dense[row[often], column[t[often]]] = w[often]
        row, t, w = row[~often], t[~often], w[~often]
        by = np.argsort(t, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(names)))])
        none = np.zeros(0, np.int64)
        parts.append([lo, n, dense, start, row[by], w[by], (none, none, np.zeros(0)), np.full(n, -np.inf)])
    by = np.argsort(doc, kind="stable")
    doc, dt, dw = doc[by], dt[by], dw[by]
    for lo in range(0, nd, CHUNK_DOCS):
        n = min(CHUNK_DOCS, nd - lo)
        a, b = np.searchsorted(doc, [lo, lo + n])
        row, t, w = doc[a:b] - lo, dt[a:b], dw[a:b]
        often = column[t] >= 0
        dense = np.zeros((n, len(common)))
        dense[row[often], column[t[often]]] = w[often]
        row, t, w = row[~often], t[~often], w[~often]
        for part in parts:
            score = part[2] @ dense.T
            _add_rare(score, row, t, w, part[3], part[4], part[5])
            _keep_best(part, score, lo, k, digits)
    rows = [(p[0] + p[6][0], p[6][1], p[6][2]) for p in parts]
    q, d, s = (np.concatenate([r[x] for r in rows] or [np.zeros(0, np.int64)]) for x in range(3))
    return pa.RecordBatch.from_arrays([qids.take(pa.array(q.astype(np.int64))), ids.take(pa.array(d.astype(np.int64))), pa.array(s.astype(np.float64))],
                                      ["qid", "doc_id", "score"])


def _keep_best(part: list, score: np.ndarray, first: int, k: int, digits: int) -> None:
    """Bring the best documents of a part's queries up to date with the next documents' scores."""
    least = part[7]
    if first == 0 and score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    # a score rounds up by half a digit at most; 0: no token shared
    q, d = np.nonzero((score > 0) & (score >= (least - 10.0 ** -digits)[:, None]))
    if not len(q):
        return
    s = np.round(score[q, d], digits)
    q, d, s = (np.concatenate(x) for x in zip(part[6], (q, d + first, s)))
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    part[6] = tuple(x[place < k] for x in (q, d, s))
    full = place == k - 1
    part[7] = np.full(part[1], -np.inf)
    part[7][q[full]] = s[full]


def weights_of_blocks(table: pa.Table) -> pa.Table:
    """Weights of the documents of a range of blocks: ``t, block, doc_id, w``, and at the first of a token's in a block, with ``most, n``,
    their highest and number."""
    posts = table.filter(pc.equal(table.column("kind"), POSTINGS))
    rest = table.filter(pc.equal(table.column("kind"), NORMS))
    doc, ids, t, w = _unpacked(posts, "ids")
    at, known, block_at, value = _unpacked(rest, "ids")
    norm, block = np.ones(len(known)), np.zeros(len(known), np.int64)
    norm[at], block[at] = value, block_at
    place = pc.index_in(ids, value_set=known)
    place = np.asarray(place.fill_null(0))[doc] if len(ids) else doc
    w, block = w / norm[place] if len(w) else w, block[place] if len(w) else doc
    order = np.lexsort((t, block))
    doc, t, w, block = doc[order], t[order], w[order], block[order]
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (t[1:] != t[:-1])])) if len(t) else np.zeros(0, np.int64)
    others = np.ones(len(t), bool)
    others[first] = False
    most, n = np.zeros(len(t)), np.zeros(len(t), np.int64)
    if len(t):
        most[first], n[first] = np.maximum.reduceat(w, first), np.diff(np.append(first, len(t)))
    return pa.table([pa.array(t), pa.array(block), ids.take(pa.array(doc)), pa.array(w), pa.array(most, mask=others), pa.array(n, mask=others)],
                    ["t", "block", "doc_id", "w", "most", "n"])


def best_of_pairs(k: int, digits: int):
    """The ``k`` best documents for each query in the blocks that are named with it: ``qid, doc_id, score``; other blocks are not scored."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")
        posts, placed, asked, pairs = (table.filter(pc.equal(kind, x)) for x in (POSTINGS, NORMS, QUERIES, PAIRED))
        if not (posts.num_rows and asked.num_rows and pairs.num_rows):
            types = [table.schema.field(c).type.value_type for c in ("qids", "ids")]
            return pa.table([pa.array([], types[0]), pa.array([], types[1]), pa.array([], pa.float64())], ["qid", "doc_id", "score"])
        doc, ids, dt, dw = _unpacked(posts, "ids")
        order = pc.array_sort_indices(ids)
        ids, place = ids.take(order), np.empty(len(ids), np.int64)
        place[np.asarray(order)] = np.arange(len(ids))
        doc = place[doc]
        at, known, block_at, _ = _unpacked(placed, "ids")
        block_of = np.zeros(len(known), np.int64)
        block_of[at] = block_at
        block = block_of[np.asarray(pc.index_in(ids, value_set=known))]
        # queries that name no block here have no part in it
        pair_q, qids, pair_block, _ = _unpacked(pairs, "qids")
        query, all_q, qt, qw = _unpacked(asked, "qids")
        there = np.array([{x: i for i, x in enumerate(qids.to_pylist())}.get(x, -1) for x in all_q.to_pylist()], np.int64)[query]
        names = np.unique(dt)
        keep = (there >= 0) & np.isin(qt, names)
        there, qt, qw = there[keep], np.searchsorted(names, qt[keep]), qw[keep]
        by = np.argsort(qt, kind="stable")
        there, qt, qw = there[by], qt[by], qw[by]
        start = np.concatenate([[0], np.cumsum(np.bincount(qt, minlength=len(names)))])
        by = np.lexsort((doc, block[doc]))
        doc, dt, dw = doc[by], np.searchsorted(names, dt[by]), dw[by]
        of_block, by = block[doc], np.argsort(pair_block, kind="stable")
        pair_q, pair_block = pair_q[by], pair_block[by]
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, waiting = [found], 0

        def kept():
            q, d, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            own = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[own], d[own], s[own]

        for b in np.unique(pair_block):
            lo, hi = np.searchsorted(of_block, [b, b + 1])
            a, z = np.searchsorted(pair_block, [b, b + 1])
            own, local = np.unique(doc[lo:hi], return_inverse=True)
            queries = np.unique(pair_q[a:z])
            row = np.full(len(qids), -1)
            row[queries] = np.arange(len(queries))
            score = np.zeros((len(queries), len(own)))
            _add_rare(score, local, dt[lo:hi], dw[lo:hi], start, there, qw, row)
            q, d = np.nonzero(score)
            held.append((queries[q], own[d], np.round(score[q, d], digits)))
            waiting += len(q)
            if waiting > PAIRS // 4:
                held, waiting = [kept()], 0
        q, d, s = kept()
        return pa.table([qids.take(pa.array(q)), ids.take(pa.array(d)), pa.array(s)], ["qid", "doc_id", "score"])

    return run


def contexts(table: pa.Table) -> pa.Table:
    """Rows ``qid, docs (position, doc_id), head`` and ``doc_id, text`` of a part -> ``qid, context``: the head, then the texts in order."""
    asked, known = pc.is_valid(table["docs"]), pc.is_valid(table["there"])
    line, lists = {}, table.filter(asked)
    for doc, text in zip(*(table.filter(known)[c].to_pylist() for c in ("doc_id", "text"))):
        line[doc] = None if text is None else "  - " + text
    out, held, size = [], [], 0
    for qid, docs, head in zip(lists["qid"].combine_chunks(), lists["docs"].to_pylist(), lists["head"].to_pylist()):
        found = sorted((d["position"], line[d["doc_id"]] or "", line[d["doc_id"]] is None) for d in docs if d["doc_id"] in line)
        facts = ["\n[Verified data facts from dashboard]\n" + "\n".join(text for _, text, none in found if not none)] if found else []
        held.append((qid, "\n".join(([] if head is None else [head]) + facts)))
        size += len(held[-1][1])
        if size > CHARS:
            out, held, size = [*out, _pairs(held, table.schema.field("qid").type)], [], 0
    return pa.Table.from_batches([*out, _pairs(held, table.schema.field("qid").type)])


def _pairs(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["qid", "context"])
