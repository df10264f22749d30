import random
import re
from collections import defaultdict

from rowkeel.llm import linededup


def plain(rows, min_chars=10):
    """id (a big number for none) -> kept text, for rows of one text an id."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df, **options).collect()}
    assert got == plain(rows)


def test_against_plain(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("aa Bb ñññ dddd".split()) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    pool += ["  Padded line HERE\t", "padded LINE here", "\x0b\x0cpadded line here\r", "ÀÉ padded line", "àé padded line", "ñ" * 9, "ñ" * 10, "", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(1000, None)]
    check(spark, rows)
    # A filter that overflows only makes more suspects; ranges of digests add up.
    check(spark, rows, max_bits=1 << 16, max_ranges=1)
    check(spark, rows, max_bits=1 << 16)


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(linededup, "filter_size", lambda *_: (1 << 16, 3))
    rng = random.Random(7)
    pool = [f"a line of number {i}" for i in range(60)]
    check(spark, [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(80)])


def test_filter_size(spark):
    docs = spark.createDataFrame([("a\nb",), (None,), ("c" * 50,)], "text string")
    assert linededup.filter_size(docs, 1 << 20, 4) == (1 << 16, 1)
    many = spark.range(1).selectExpr("repeat('x\\n', 300000) AS text")
    assert linededup.filter_size(many, 1 << 20, 4) == (1 << 20, 4) and linededup.filter_size(many, 1 << 29, 4) == (1 << 23, 1)


def test_only_losers_are_shuffled(spark):
    """Most texts lose nothing: the filter of losers rules them out."""
    rows = [(i, f"own line of number {i}\n" + ("the line that two hold" if i in (3, 50) else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    from rowkeel.llm.common import mark_members

    keys = spark.createDataFrame([(i,) for i in range(0, 4000, 100)], "k long")
    marked = mark_members(spark.range(4000), F.col("id"), keys, "hit").collect()
    assert all(r.hit for r in marked if r.id % 100 == 0) and sum(r.hit for r in marked) < 400
    none = mark_members(spark.range(10), F.col("id"), keys.where("false"), "hit").collect()
    assert len(none) == 10 and not any(r.hit for r in none)
    assert {r.doc_id for r in linededup.dedup_lines(df).where("n_dropped > 0").collect()} == {50}


def test_packed_parts():
    import numpy as np

    for n in (0, 1, 5000, 60_000):
        at = np.sort(np.random.default_rng(n).choice(1 << 16, n, replace=False))
        assert np.flatnonzero(linededup._unpack(linededup._pack(at))).tolist() == at.tolist()


def test_odd(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs)
    assert set(out.columns) == {*odd_docs.columns, "n_dropped"}
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text is None and (by[1][0].n_lines, by[1][0].n_dropped) == (1, 0) and by[2][0].text == ""
    assert [(r.text, r.n_dropped) for r in by[6]] == [("same line of text\nother words", 0)] * 2
    assert [(r.text, r.n_dropped) for r in by[7]] == [("", 2)]
    assert len(by[4][0].text) > 1_000_000
    assert linededup.dedup_lines(no_docs).count() == 0


def test_lists_follow_rows_not_ids(spark, monkeypatch):
    # 300 texts without an id and 300 under one, of 4 lines each, all held by earlier documents too.
    line = "repeated line number {}".format
    texts = ["\n".join(line(4 * i + k) for k in range(4)) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(900, t) for t in texts], "doc_id long, text string").repartition(3)
    lists, plain_lists = [], getattr(linededup, "drop_lists")
    monkeypatch.setattr(linededup, "drop_lists", lambda gone: lists.append(plain_lists(gone)) or lists[-1])
    got = linededup.dedup_lines(df).collect()
    assert {(r.text, r.n_dropped) for r in got if r.doc_id is None or r.doc_id == 900} == {("", 4)}
    assert sorted(r.text for r in got if r.doc_id is not None and r.doc_id < 900) == sorted(texts)
    assert max(len(r._drop) for r in lists[0].collect()) == 4
