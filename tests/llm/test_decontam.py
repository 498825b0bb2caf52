"""Decontamination: exact, cased and re-parameterised leaks, consistency of slots, and clean texts that look alike."""

import pytest

from kpiforge.llm import decontam
from kpiforge.llm.decontam import clean, leaks

ITEM = "A train leaves the station at 30 km per hour and meets Alice after 45 minutes, then Alice walks 12 miles home to see her brother Bob in 45 minutes."
SAME = ITEM.upper().replace("KM", "KM")
SWAPPED = ITEM.replace("30", "70").replace("45", "50").replace("12", "8,500").replace("Alice", "Maria").replace("Bob", "Jo Ann").replace("km", "miles")
MIXED = ITEM.replace("45 minutes,", "46 minutes,").replace("then Alice", "then Carol").replace("12 miles", "45 miles").replace("Bob in 45", "Alice in 30")
PLAIN = "The quick brown fox jumps over the lazy dog while nobody is watching the quiet house by the sea."


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id long")


LONG = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)} of" if i % 3 else f"text{chr(97 + i)}" for i in range(24))

ITEMS = [(8, LONG), (1, ITEM), (2, PLAIN), (3, None), (4, ""), (5, "five small words stand here"), (6, "too few words"), (7, PLAIN)]


def test_leaks(make_docs, bench):
    around = "Some unrelated words come first here. {} And other words of no interest follow the passage."
    docs = [(10, around.format(ITEM)), (11, SWAPPED), (12, around.format(MIXED)), (13, around.format(PLAIN)), (14, "nothing at all to see"), (15, None), (16, ""),
            (17, around.format("FIVE small words, stand here")), (18, "too few words"), (13, around.format(PLAIN)), (None, PLAIN),
            (19, around.format(" ".join(PLAIN.split()[:9]))),
            (21, around.format(" ".join(LONG.split()[7:22]))), (22, around.format(" ".join(LONG.split()[7:18]))), (20, "noise " * 50000 + PLAIN + " noise" * 50000)]
    out = leaks(make_docs(docs), bench(ITEMS))
    got = sorted(((r["doc_id"], r["item_id"]) for r in out.collect()), key=str)
    assert got == sorted([(10, 1), (11, 1), (13, 2), (13, 7), (13, 2), (13, 7), (17, 5), (None, 2), (None, 7), (20, 2), (20, 7), (21, 8)], key=str)
    of = {(r["doc_id"], r["item_id"]): r for r in out.collect()}
    assert of[10, 1]["n_changed"] == 0 < of[10, 1]["n_slots"] and of[11, 1]["n_changed"] >= 6
    kept = clean(make_docs(docs), bench(ITEMS))
    assert kept.columns == make_docs([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 14, 15, 16, 18, 19, 22]


def test_each_occurrence_is_judged_by_itself(make_docs, bench):
    parallel = " ".join(f"In week {i} the small shop by the river sold {i * 7 + 3} boxes of green apples to {n}." for i, n in enumerate(
        ["Ann", "Bob", "Cid", "Dan", "Eve"], 1))
    other = ITEM.replace("30", "71").replace("45", "52").replace("12", "19").replace("Alice", "Paula").replace("Bob", "Karl")
    inserted = ITEM.replace("and meets", "with few stops on the way and meets")
    docs = [(1, f"First this one. {ITEM} Then that one. {SWAPPED}"), (2, f"{SWAPPED} Then that one. {other} More. {MIXED}"), (3, f"Words. {parallel} Words."),
            (4, f"{MIXED} And once more. {MIXED}"), (5, f"{MIXED} Then. {inserted} Then. {MIXED}"), (6, f"{ITEM} {ITEM}")]
    items = [(1, ITEM), (2, parallel)]
    out = {(r["doc_id"], r["item_id"]): r for r in leaks(make_docs(docs), bench(items)).collect()}
    assert sorted(out) == [(1, 1), (2, 1), (3, 2), (5, 1), (6, 1)]
    assert out[3, 2]["coverage"] == 1.0 and out[3, 2]["n_changed"] == 0 < out[3, 2]["n_slots"] and out[1, 1]["coverage"] == 1.0
    assert [r["doc_id"] for r in clean(make_docs(docs), bench(items)).collect()] == [4]


def test_copies_in_other_case_and_inside_a_sentence(make_docs, bench):
    names = "Yesterday Ann met Bob and Cid at noon while Dan told Eve about Fay and Gus near Hal before Ivy saw Joe and Kim again at home."
    short, numbers = "Name the seven seas of legend", "What is 12 13 14 15 plus 9?"
    items = [(1, names), (2, short), (3, numbers), (4, ITEM)]
    around = "some words come first {} and others of no interest follow it"
    docs = [(10, around.format(names)), (11, around.format(names.lower())), (12, around.format(names.upper())), (13, around.format(short)),
            (14, around.format(short.lower())), (15, around.format(numbers)), (16, around.format(ITEM.lower())), (17, MIXED),
            (18, around.format(" ".join(names.lower().split()[5:19]))), (19, around.format(" ".join(names.lower().split()[5:14]))),
            (20, around.format("what is 12 13 14 16 plus 8?")), (21, f"{MIXED} But {' '.join(ITEM.lower().split()[8:22])}")]
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(make_docs(docs), bench(items)).collect())
    assert got == [(10, 1), (11, 1), (12, 1), (13, 2), (14, 2), (15, 3), (16, 4), (18, 1), (20, 3), (21, 4)]
    assert sorted(r["doc_id"] for r in clean(make_docs(docs), bench(items)).collect()) == [17, 19]


def test_blocks_of_items(make_docs, bench, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 20)
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", ("item_id", "text", 8, 20))
    docs = [(10, ITEM), (13, PLAIN), (14, "nothing at all to see"), (17, "five small words stand here")]
    assert len(list(decontam.item_blocks(bench(ITEMS)))) > 2
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(make_docs(docs), bench(ITEMS)).collect()) == [(10, 1), (13, 2), (13, 7), (17, 5)]
    assert [r["doc_id"] for r in clean(make_docs(docs), bench(ITEMS)).collect()] == [14]


def test_empty_tables(make_docs, bench):
    assert leaks(make_docs([]), bench(ITEMS)).collect() == []
    assert leaks(make_docs([(1, PLAIN)]), bench([])).collect() == []
    assert clean(make_docs([(1, PLAIN)]), bench([])).count() == 1 and clean(make_docs([]), bench(ITEMS)).count() == 0


def test_every_full_copy_in_the_given_tables_is_found(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    texts = items.collect()
    assert {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in texts if b["text"] in (d["text"] or "")} <= found
