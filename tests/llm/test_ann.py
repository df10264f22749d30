import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeel.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in (i for i in ok if i % every == 0):
        near = [(-(ok[q] @ x) / (np.linalg.norm(ok[q]) * np.linalg.norm(x)), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def found(spark, rows, **options):
    out = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 24)))]
    want = brute(rows, 10, 5)
    got = found(spark, rows, every=10, shard_bytes=400 * (8 * 24 + 12 * 16), ef_search=64)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in got:
        for i, s in got[q]:
            x, y = (np.array(rows[j][1], np.float32).astype(float) for j in (q, i))
            assert s == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-12)


def test_recall_at_production_parameters(spark):
    """10,000 vectors of 64 entries in loose clusters, in one shard of the default size, against brute force; the user's columns don't matter."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(40, 64))[rng.integers(40, size=10_000)] + 1.5 * rng.normal(size=(10_000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    for c in ("v", "shard", "ids", "node", "level", "links", "dim", "score", "rank", "query_id"):
        df = df.withColumn(c, F.lit("clash"))
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, 10_000, 50)] = -2
    want = np.argsort(-near, axis=1)[:, :5]
    assert set(got) == set(range(0, 10_000, 50))
    assert sum(len(got[50 * q] & set(w.tolist())) for q, w in enumerate(want)) >= 0.95 * want.size


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=8).tolist()
    rows = [(i, common) for i in range(0, 300)] + [(i, rng.normal(size=8).tolist()) for i in range(300, 500)]
    got = found(spark, rows, every=50)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[250]] == [0, 1, 2, 3, 4]
    want = brute(rows, 50, 5)
    assert {q: [i for i, _ in v] for q, v in got.items() if q >= 300} == {q: [i for i, _ in v] for q, v in want.items() if q >= 300}


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (50, [2.0, 2.0]), (50, [2.0, 2.0]), (100, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0])]
    got = found(spark, rows, every=50)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [7, 50, 8], 50: [7, 0, 8]}
    assert found(spark, [(1, [1.0])], every=50) == {} and found(spark, [(0, [1.0])], every=50) == {}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
