"""Chunks and ranking on small tables."""

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowkeel.retrieval import bm25, chunk_words, rank_documents

texts = st.lists(st.sampled_from(["a", "bb", "é", "漢字", " ", "  ", "\n", "\t", "\x0b", " ", "\x85", "😀", "x y"]), max_size=30).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.one_of(st.none(), texts), min_size=1, max_size=8), size=st.integers(1, 4), data=st.data())
def test_chunks_rebuild_the_text(spark, docs, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(docs)], "id int, text string, row string")
    got = {}
    for r in chunk_words(df, size=size, overlap=overlap).orderBy("id", "chunk").collect():
        assert r.row == "kept" and r.chunk == len(got.setdefault(r.id, []))
        got[r.id].append(r)
    for i, text in enumerate(docs):
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        step = size - overlap
        want = [words[a : a + size] for a in range(0, max(1, len(words) - overlap), step)] if words else []
        assert [(r.start, r.end, r.n_words) for r in got.get(i, [])] == [(w[0][0], w[-1][1], len(w)) for w in want]
        assert all(r.chunk_text == text[r.start : r.end] for r in got.get(i, []))


def test_chunks_of_long_texts(spark):
    df = spark.createDataFrame([(1, "  " + "word " * 100_000, 5)], "id int, text string, chunk int")
    out = chunk_words(df, size=1000, overlap=100)
    assert out.columns == ["id", "chunk", "start", "end", "n_words", "chunk_text"]
    rows = out.orderBy("chunk").collect()
    assert len(rows) == 111 and rows[1].start == 2 + 900 * 5 and rows[-1].end == 2 + 5 * 100_000 - 1
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert chunk_words(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chunk_words(df, size=5, overlap=5)


def brute(docs, queries, k):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held, asked = {}, {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, []).extend(words(t))
    for q, t in queries:
        if q is not None:
            asked.setdefault(q, set()).update(words(t))
    n, df = len(held), Counter(w for t in held.values() for w in set(t))
    mean = sum(map(len, held.values())) / max(1, n)
    out = set()
    for q, terms in asked.items():
        score = Counter()
        for i, t in held.items():
            tf = Counter(t)
            for w in terms & set(t):
                idf = math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
                score[i] += round(1e6 * idf * (tf[w] * 2.2) / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)))
        out |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


DOCS = [(1, "The cat sat on the mat"), (2, "the dog, the dog!"), (3, None), (4, ""), (5, "Éclair für den Hund 42"), (6, "the cat sat on the mat"), (None, "cat cat cat"), (7, "the " * 500), (2, "second text of two")]
ASKED = [(1, "Where is the cat?"), (2, "HUND 42 éclair"), (3, None), (4, "nothing known"), (None, "cat"), (1, "dog"), (5, "the the the")]


@pytest.mark.parametrize("options", [{}, {"k": 2}, {"max_terms": 2}])
def test_ranking_equals_brute_force(spark, options):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id int, text string, score string, q int").repartition(3)
    queries = spark.createDataFrame([(*q, "x") for q in ASKED], "item_id int, text string, d string")
    got = rank_documents(docs, queries, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(DOCS, ASKED, options.get("k", 10))


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    queries = spark.createDataFrame(ASKED, "item_id int, text string")
    assert rank_documents(docs.where("false"), queries).count() == 0 and rank_documents(docs, queries.where("false")).count() == 0


def test_no_shuffle_by_term(spark):
    """Scores are summed where the documents lie, and the k best are taken before the last shuffle."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), (F.col("id") % 7).cast("string")).alias("text"))
    plan = rank_documents(docs, docs.limit(5).withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2 and exchanges[0].startswith("q#") and exchanges[1].startswith("d#") and plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning")
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and plan.count("WindowGroupLimit") == 2


def test_tasks_grow_with_the_scores(spark):
    """A task's scores are bounded at any size: neither shuffle partitions nor bytes, both alike here, set how many tasks there are."""

    def tasks(n_docs):
        docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), F.lit("the word").alias("text"))
        queries = spark.range(100).select(F.col("id").alias("item_id"), F.lit("the").alias("text"))
        plan = rank_documents(docs, queries)._jdf.queryExecution().executedPlan().toString()
        return int(re.search(r"Exchange hashpartitioning\(d#\w+, (\d+)\)", plan)[1])

    assert tasks(5_000) == 4 and tasks(50_000) == 10


def test_ranking_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "_TASK_WORDS", 50)
    monkeypatch.setattr(bm25, "_TASK_SCORES", 2)
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3)
    assert {tuple(r) for r in rank_documents(docs, spark.createDataFrame(ASKED, "item_id int, text string"), max_terms=3).collect()} == brute(DOCS, ASKED, 10)
