"""N-gram Jaccard join against all pairs, on fixtures with copies, near copies, shared passages and odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge.llm import ngram_join
from kpiforge.llm.ngram_join import divide_skip, jaccard_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            up[root(a)] = root(b)
    low = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            low[root(k)] = min(low.get(root(k), d), d)
    return sorted(((d, len(sets[k]), low.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)), key=str)


def changed(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 30, 60, 120]))]
        if rng.random() < 0.5:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.randrange(1, size)):
            out.append(changed(base, rng.choice([0, 0, 1, 2, 3, 5]), rng))
    out += ["", None, " \t\n", "one", "ONE", "a b c d", "a  b\nc D", "x " * 500, "x " * 501]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)] + [(1, out[0]), (None, "a b c d"), (None, "alone of all"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(make_docs, seed):
    docs = corpus(seed)
    got = sorted((tuple(r) for r in jaccard_components(make_docs(docs)).collect()), key=str)
    assert got == brute(docs)


def test_long_lists_and_many_members(make_docs, monkeypatch):
    """A hot group: more near copies than LONG and BLOCK allow in one list and one task."""
    monkeypatch.setattr(ngram_join, "LONG", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "FLUSH", 1 << 14)
    rng = random.Random(5)
    base = [f"w{rng.randrange(80)}" for _ in range(70)]
    docs = [(i, changed(base, rng.choice([0, 1, 2, 4, 6]), rng)) for i in range(150)]
    docs += [(1000 + i, " ".join(base[:50]) + f" tail{i} " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(4, 40)))) for i in range(60)]
    got = sorted((tuple(r) for r in jaccard_components(make_docs(docs)).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(make_docs):
    assert jaccard_components(make_docs([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 6))
def test_divide_skip_counts(sets, least, longest):
    lists = [np.array(sorted(s)) for s in sets]
    count = {i: sum(i in s for s in sets) for i in range(13)}
    assert divide_skip(lists, least, longest) == {i: n for i, n in count.items() if n >= least}
