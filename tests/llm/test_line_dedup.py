"""Line templates: exact recurrences against plain Python, variable fields, first document, odd rows."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import line_dedup
from kpiforge.llm.line_dedup import ANY, drop_recurring, grow_leaf, repeated_passages


def expected(docs, k=3):
    """Lines equal but for words with digits, in k documents or more, go from all but the first document."""
    seen = {}
    mask = lambda l: tuple("<*>" if re.search("[0-9]", w) else w for w in l.split())
    for n, (d, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            if line.split():
                seen.setdefault(mask(line), {})[n] = d
    out = []
    for n, (d, t) in enumerate(docs):
        if t is None:
            out.append((d, None))
            continue
        keep = []
        for line in t.split("\n"):
            owners = seen.get(mask(line), {})
            first = min(owners, key=lambda x: (owners[x] is None, owners[x] or 0)) if owners else n
            if len(owners) < k or docs[n] == docs[first]:
                keep.append(line)
        out.append((d, "\n".join(keep)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    common = [" ".join(f"c{chr(97 + i)}{chr(97 + j)}" for j in range(4 + i)) for i in range(5)]
    docs = []
    for i in range(60):
        lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('qrst')}{rng.choice('xyz')}" for _ in range(rng.randrange(6, 14))) for _ in range(4)]
        if rng.random() < 0.6:
            lines.insert(rng.randrange(4), rng.choice(common))
        if rng.random() < 0.3:
            lines.append(f"Page {rng.randrange(9)} of {rng.randrange(99)} printed")
        if rng.random() < 0.3:
            lines.insert(0, "")
        docs.append((i * 7, "\n".join(lines)))
    return docs


def test_exact_recurrences(make_docs):
    for seed in (1, 2):
        docs = corpus(seed) + [(5000, None), (5001, ""), (5002, " \n\t\n"), (None, "Page 1 of 2 printed\nown line of it"), (0, corpus(seed)[0][1])]
        for parts in (1, 5):
            out = drop_recurring(make_docs(docs).repartition(parts))
            assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == expected(docs)
            assert out.columns == [*make_docs([]).columns, "n_lines", "n_dropped"]


def test_words_vary_after_the_leading_ones(make_docs):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve"]
    docs = [(i, f"unique{chr(97 + i)} text here\nThis copy was made for reader {n} alone by request") for i, n in enumerate(names)]
    docs += [(9, "This copy was made in another way and for no reader")]
    out = {r["doc_id"]: r for r in drop_recurring(make_docs(docs)).collect()}
    assert out[0]["n_dropped"] == 0 and "Ann" in out[0]["text"]
    assert all(out[i]["text"] == f"unique{chr(97 + i)} text here" and out[i]["n_dropped"] == 1 for i in range(1, 5))
    assert out[9]["n_dropped"] == 0


def test_leaf():
    lines = [np.array(x, np.uint32) for x in ([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14], [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 99, 98],
                                              [2, 3, 4, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59])]
    of, templates = grow_leaf(lines)
    assert of.tolist() == [0, 0, 1] and templates[0].tolist() == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, ANY, ANY]


def every_template(lines, depth=3, similar=0.7):
    """The tree's rule, word for word: a line is compared with all templates so far."""
    out, templates = [], []
    for line in lines:
        same = [sum(a == b for a, b in zip(t[depth:], line[depth:])) for t in templates]
        best = max(range(len(same)), key=lambda k: (same[k], -k), default=None)
        if best is not None and same[best] >= similar * max(len(line) - depth, 0):
            templates[best] = [a if a == b else ANY for a, b in zip(templates[best], line)]
            out.append(best)
        else:
            templates.append(list(line))
            out.append(len(templates) - 1)
    return out, templates


@pytest.mark.parametrize("size,kinds,noise", [(3, 3, 2), (4, 5, 3), (8, 6, 3), (13, 20, 4), (20, 60, 7), (40, 30, 14)])
def test_leaf_of_many_lines_follows_the_rule(size, kinds, noise):
    rng = np.random.default_rng(size)
    base = rng.integers(2, 12, (kinds, size))
    lines = []
    for _ in range(400):
        line = base[rng.integers(kinds)].copy()
        for _ in range(rng.integers(0, noise)):
            line[rng.integers(min(3, size - 1), size)] = rng.integers(2, 14)
        line[:3] = [2, 3, 4][:size]
        lines.append(line.astype(np.uint32))
    of, templates = grow_leaf(lines)
    want, made = every_template([x.tolist() for x in lines])
    assert of.tolist() == want and [t.tolist() for t in templates] == made
    assert len(made) < 400


def test_leaf_of_very_many_lines():
    """Lines with equal openings that share no template: time follows their number, not its square."""
    rng = np.random.default_rng(1)
    lines = np.concatenate([np.full((40_000, 3), 7), rng.integers(2, 1 << 31, (40_000, 17))], 1).astype(np.uint32)

    def seconds(n):
        start = time.process_time()
        assert len(grow_leaf(list(lines[:n]))[1]) == n
        return time.process_time() - start

    assert seconds(40_000) < 12 * seconds(5_000) + 1  # eight times the lines


def test_long_passages_repeat_once(make_docs):
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    docs = [(i, f"start of document {chr(97 + i)} {chr(98 + i)}\n{passage}\nend of {chr(97 + i)}{chr(97 + i)}") for i in range(12)]
    out = drop_recurring(make_docs(docs)).orderBy("doc_id").collect()
    assert [passage in r["text"] for r in out] == [True] + [False] * 11
    assert all(len(r["text"].split("\n")) == (3 if i == 0 else 2) for i, r in enumerate(out))


def test_passages_inside_lines(make_docs):
    word = lambda k, n: " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    passage, two, short = word("p", 60), word("é", 53), word("s", 49)
    docs = [(i, f"{word(f'a{chr(97 + i)}', 3 * i + 1)} {passage}  {word(f'b{chr(97 + i)}', i + 2)}\nown line {chr(97 + i)}") for i in range(5)]
    docs += [(10, f"head of ten {two} tail of ten"), (11, f"other {two}\nlast"), (12, f"{two}\nlast one"), (13, f"x {short} y"), (14, f"z {short} {short}"),
             (15, f"one {passage} between {two} end"), (None, f"nameless {two} text"), (16, f"same {word('t', 55)} twice {word('t', 55)}")]
    out = {r["doc_id"]: r for r in drop_recurring(make_docs(docs).repartition(3)).collect()}
    text = {d: r["text"] for d, r in out.items()}
    assert text[0] == docs[0][1] and text[10] == docs[5][1] and all(text[d] == t for d, t in docs if d in (13, 14, 16))
    for i in range(1, 5):
        assert text[i] == f"{word(f'a{chr(97 + i)}', 3 * i + 1)} {word(f'b{chr(97 + i)}', i + 2)}\nown line {chr(97 + i)}"
    assert (text[11], text[12], text[15], text[None]) == ("other\nlast", "last one", "one between end", "nameless text")
    assert {d: r["n_dropped"] for d, r in out.items() if r["n_dropped"]} == {12: 1} and out[12]["n_lines"] == 2


def every_run(docs, long=50):
    """Cuts by the rule: each run of 50 words of a line goes from all documents but the first; runs that overlap are one cut."""
    owners, own = {}, {}
    for d, text in docs:
        at = 0
        for line in text.split("\n"):
            words = list(re.finditer(rb"[^ ]+", line.encode()))
            for k in range(len(words) - long + 1):
                run = tuple(w[0] for w in words[k: k + long])
                owners.setdefault(run, set()).add(d)
                own.setdefault(d, []).append((run, at + words[k].start(), at + words[k + long - 1].end()))
            at += len(line.encode()) + 1
    out = {}
    for d, runs in own.items():
        for run, s, e in sorted(runs, key=lambda r: r[1:]):
            if min(owners[run]) != d:
                cuts = out.setdefault(d, [])
                if cuts and s <= cuts[-1]:
                    cuts[-1] = max(cuts[-1], e)
                else:
                    cuts += [s, e]
    return out


def edited_copies(seed):
    rng = random.Random(seed)
    few, many = ["ab", "é", "c", "dd"], [f"w{x}{y}" for x in "abcdefghijklmnop" for y in "abcdefghijklmnop"]
    bases = [[rng.choice(v) for _ in range(150)] for v in (few, few[:2], many, many, many)] + [["x"] * 150]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(150)] = rng.choice(["new", "other", "ab"])
            low = rng.randrange(60)
            words = words[low: low + rng.randrange(45, 150)] + rng.choice([[], words[:70]])
            lines.append(f"l{rng.random()} " + "".join(w + rng.choice([" ", " ", "  "]) for w in words))
        docs.append((i * 3, "\n".join(lines)))
    return docs


def test_passages_of_edited_copies_follow_the_rule(spark, make_docs):
    """Copies cut anywhere and edited anywhere, few words and periods: the same cuts as run by run."""
    none = spark.createDataFrame([], "x0 long, x1 long, gone array<boolean>")
    for seed in (1, 2, 3):
        docs = edited_copies(seed)
        got = repeated_passages(line_dedup._source(make_docs(docs).repartition(4), "doc_id", "text"), none).collect()
        assert {r["x0"]: r["cuts"] for r in got} == every_run(docs)


def test_a_passage_is_few_rows(make_docs, monkeypatch):
    """A passage of 2,000 words in 20 documents is dealt and joined by segments, not by each of its 1,951 runs."""
    passage, rows = " ".join(f"p{i}" for i in range(2000)), {}
    table = line_dedup.stored

    def counted(df, name):
        rows[name] = (out := table(df, name)).count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    docs = [(i, f"{' '.join(f'h{i}of{k}' for k in range(i + 1))} {passage}") for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in drop_recurring(make_docs(docs)).collect()}
    assert all(("p1000" in t) == (d == 0) for d, t in out.items())
    assert max(rows.values()) < 20 * 1951 / 4, rows


def test_very_long_document_and_empty_table(make_docs):
    big = "\n".join(f"line {chr(97 + i % 26)} {'word ' * (i % 7)}x{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}" for i in range(15000))
    docs = [(1, big), (2, big), (3, big), (4, "other")]
    out = {r["doc_id"]: r["n_dropped"] for r in drop_recurring(make_docs(docs)).collect()}
    assert out[1] == 0 and out[2] == out[3] == 15000 and out[4] == 0
    assert drop_recurring(make_docs([])).collect() == []
    assert drop_recurring(make_docs(docs)).filter(F.col("n_lines") == 15000).count() == 3
