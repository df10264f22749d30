import re

import pytest
from conftest import LONG
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowkeel.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(doc, items, size):
    """Covered words and items of a text, by trying each window at each place."""
    w, hit, named = plain_words(doc), set(), set()
    for item, text in items:
        b = plain_words(text)
        for win in {tuple(b[i : i + size]) for i in range(max(1, len(b) - size + 1))} if b else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    named.add(item)
    return len(w), hit, named


texts = st.lists(st.sampled_from("a b c d a b the The é É 7 x9 , . \n - \x00 \x7f a-b c.d".split(" ")), max_size=40).map(" ".join)


@settings(max_examples=2000, deadline=None)
@given(texts, st.lists(texts, max_size=4), st.integers(1, 5), st.integers(1, 3), st.integers(1, 6))
def test_search_equals_trying_all_places(doc, items, size, block, suffix):
    items = [(str(i), t) for i, t in enumerate(items)]
    held = {}
    for i, t in items:
        for win in set(decontam.windows(t.encode(), size)):
            held.setdefault(win, []).append(i)
    w = decontam.words(doc.encode())
    spans, named = decontam.Search(held.items(), block, suffix).spans(w)
    n, hit, want = plain(doc, items, size)
    assert len(w) == n and {p for a, z in spans for p in range(a, z)} == hit and named == want
    assert all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in decontam.words(text.encode())] == plain_words(text)


DOCS = [
    (1, "One two three four. FIVE six seven eight nine ten eleven"),
    (2, "before " * 30 + "one two three four five six seven eight nine ten" + " after" * 30),
    (3, None),
    (4, ""),
    (5, "... --- ..."),
    (6, "a short item"),
    (6, "a short item"),
    (None, "it is a short item, and a short item"),
    (7, "clean words of no item at all"),
]
ITEMS = [(10, "one two three four five six seven eight nine ten"), (9, "A short ITEM!"), (9, "a short item"), (11, None), (12, ""), (13, "?!"), (None, "clean words")]


@pytest.mark.parametrize("bound", [{}, {"max_windows": 1}, {"max_bytes": 40}])
def test_overlaps(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    for c in ("s", "n", "row", "t", "win", "n_hit", "items", "starts"):
        docs = docs.withColumn(c, F.lit("clash"))
    rows = decontam.find_overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), **bound).collect()
    assert len(rows) == len(DOCS)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.contaminated, r.n, r.row) for r in rows)
    assert got == [
        (0, 9, 6, ["9"], [(2, 5), (6, 9)], True, "clash", "clash"),
        (1, 11, 10, ["10"], [(0, 10)], True, "clash", "clash"),
        (2, 70, 10, ["10"], [(30, 40)], True, "clash", "clash"),
        *[(i, 0, 0, [], [], False, "clash", "clash") for i in (3, 4, 5)],
        *[(6, 3, 3, ["9"], [(0, 3)], True, "clash", "clash")] * 2,
        (7, 7, 2, [], [(0, 2)], True, "clash", "clash"),  # an item without an id hits, but has no name
    ]


def test_ids_are_sorted_as_strings(spark):
    items = spark.createDataFrame([(i, "same words") for i in (100, 9, 20, 9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the same words again")], "doc_id long, text string")
    for bound in ({}, {"max_windows": 2}):
        (r,) = decontam.find_overlaps(docs, items, **bound).collect()
        assert r["items"] == ["100", "20", "9"] and r.n_items == 3 and r.n_hit == 2


def test_drop(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items, max_share=0.3).collect()) == [2, 3, 4, 5, 7]
    assert decontam.drop_contaminated(odd_docs, items.where("false")).count() == odd_docs.count()
    assert decontam.find_overlaps(no_docs, items).count() == 0


def test_long_text(spark, odd_docs):
    items = spark.createDataFrame([(1, "gamma delta alpha " * 20), (2, "beta"), (3, LONG)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_overlaps(odd_docs.where("doc_id = 4"), items).collect()}
    assert rows[4].n_words == rows[4].n_hit == 180_000 and rows[4]["items"] == ["2", "3"]
