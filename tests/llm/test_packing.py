"""Packing: exact tiling of every document, bounds, little padding, and the tokenizer's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kpiforge.llm.common import byte_view
from kpiforge.llm.packing import WordIds, cut, first_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(out, docs, tokenizer, capacity):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in docs]
    left = [(d, a) for (d, _), a in zip(docs, ids)]
    cover = {}
    for r in out:
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for d, group in cover.items():
        want = sorted((s, n, zlib.crc32(a[s:s + n].tobytes()), len(a)) for x, a in left if x == d
                      for s, n in zip(np.cumsum([0, *[p for p, _ in cut(len(a), capacity)]])[:-1].tolist(), [p for p, _ in cut(len(a), capacity)]))
        assert sorted(group) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    pad = total = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(seqs) == list(range(len(seqs))) and total == sum(map(len, ids))
    return pad / total


def test_pack(make_docs, tokenizer):
    rng = random.Random(1)
    docs = [(i, " ".join(f"Word{rng.randrange(50)}," for _ in range(rng.choice([1, 5, 40, 300, 900])))) for i in range(120)]
    docs += [(500, ""), (501, None), (502, "  \n"), (503, "x " * 30000), (3, docs[3][1]), (None, "no id"), (504, "a<|endoftext|>b don't")]
    assert check(pack(make_docs(docs), PATH).collect(), docs, tokenizer, 4096) < 0.02


def test_empty_table_and_single_document(make_docs, tokenizer):
    assert pack(make_docs([]), PATH).collect() == []
    out = pack(make_docs([(1, None)]), PATH).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in out] == [(1, 0, 1, 1, 0, 0)]


@given(st.integers(1, 20000), st.sampled_from([64, 100, 4096]))
def test_cut_tiles_and_fits_its_class(length, capacity):
    pieces = cut(length, capacity)
    assert sum(n for n, _ in pieces) == length
    for n, c in pieces:
        assert capacity // (c + 1) <= n <= capacity // c  # c of them fit
        assert c * n >= capacity - 2 * c - capacity // 32  # and nearly fill a sequence


def test_first_fit_bounds():
    lengths = np.array([5, 1, 9, 10, 3, 3, 3, 1])
    bins, offsets = first_fit(lengths, 10)
    for b in set(bins):
        own = sorted((o, n) for o, n in zip(offsets[bins == b], lengths[bins == b]))
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 10


def test_ids_of_parts_equal_the_tokenizers(tokenizer):
    words = WordIds(PATH)
    rng = random.Random(3)
    letters = list("abcDEF'.,-–—…é̀ÉßΣςσ12٣ \t\n\r\x0b\x0c  ‍😀中文’stllvedm<|>") + ["<|endoftext|>", "don't", "I'VE", ",'s", "<|"]
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        data, bounds = byte_view(pa.array([t, "x " + t]))
        ids, edge = words.encode(data, bounds)
        for i, s in enumerate([t, "x " + t]):
            assert ids[edge[i]:edge[i + 1]].tolist() == tokenizer.encode(s, add_special_tokens=False).ids, s
