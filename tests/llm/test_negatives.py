import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeel.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, scale=256.0, low=80):
    ok = {(i, str(l), tuple(np.floor(scale * np.array(v, np.float32).astype(float)))) for i, v, l in rows if None not in (i, v, l) and all(c is not None and np.isfinite(c) for c in v)}
    anchors = {}
    for i, l, v in sorted(ok):
        if i % every == 0:
            anchors.setdefault(i, (l, v))
    out = set()
    for a, (label, v) in anchors.items():
        near = sorted((-int(np.dot(v, x)), i, l) for i, l, x in ok if i != a and len(x) == len(v))
        for s, p, _ in [x for x in near if x[2] == label][:k]:
            fits = [x for x in near if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits)}
    return out


def found(spark, rows, parts=3, **options):
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(n, d, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(12, d))
    return [(i, (mid[i % 12] + spread * rng.normal(size=d)).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 40 * (8 * 16 + 64), "max_clusters": 9}, {"sample_rows": 30}, {"k": 1}, {"k": 9, "low": 95}])
def test_equals_brute_force(spark, options, monkeypatch):
    rows = clustered(900, 16)
    if "shard_bytes" in options:
        deal = negatives.deal
        monkeypatch.setattr(negatives, "deal", lambda c, n, room, first: deal(c, n, 40, first))  # many shards of few rows
    want = brute(rows, 25, options.get("k", 5), low=options.get("low", 80))
    assert want and found(spark, rows, every=25, **options) == want


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, a = rng.normal(size=(400, 8)) * 50, rng.normal(size=(20, 8)) * 50
    lists = negatives.Lists(0, negatives.kmeans(x, 12))
    near, far = lists.assign(x)
    lists.radii = np.array([far[near == c].max(initial=-np.inf) for c in range(12)])
    low, high = lists.bounds(a)
    score = a @ x.T
    assert (score <= high[:, near]).all() and (score >= low[:, near]).all()


def test_clusters_are_skipped():
    """Far clusters are not visited: their nodes would raise."""
    rng = np.random.default_rng(3)
    mid = np.eye(8) * 1000
    x = np.concatenate([m + rng.normal(size=(20, 8)) for m in mid])
    lists = negatives.Lists(0, mid.copy(), np.full(8, 20.0))
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(np.arange(8), 20).astype(np.int32)), "ids": pa.array([[i] for i in range(160)]), "label": pa.array(["a"] * 160), "v": pa.array(list(x))})
    shard = negatives.Shard(lists, [part])
    shard.x[20:] = np.nan  # scores of those would be NaN and found
    shard.ids[20:] = [None] * 140
    low, high = lists.bounds(x[:1])
    got = list(shard.visit(0, "a", x[0], [{"slot": 0, "low": -np.inf, "high": np.inf, "kth": -np.inf}], True, 5, (low[0], high[0])))
    score = x[:20] @ x[0]
    assert [i for _, i, _ in got] == sorted(range(1, 20), key=lambda i: (-score[i], i))[:5]


def test_copies_ties_and_hot_vectors(spark):
    """A third of all rows are one vector, with several labels."""
    rows = clustered(300, 6, spread=0.01) + [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5], i % 3) for i in range(150)]
    assert found(spark, rows, every=25) == brute(rows, 25, 5)
    flat = [(i, [1.0, 1.0], i % 2) for i in range(40)]
    assert found(spark, flat, every=10) == brute(flat, 10, 5)


def test_shards_that_many_ask(spark):
    rows = spark.createDataFrame(clustered(400, 5), SCHEMA).select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    lists = negatives.index(rows, k=3)
    ends = F.array(F.struct(F.lit(0).alias("slot"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(float("-inf")).alias("kth")))
    asked = rows.where("vec_id % 4 = 0").select(F.col("vec_id").alias("anchor"), "label", "v", ends.alias("windows"))
    one, many = (sorted(map(tuple, negatives.search(lists, asked, same=True, max_asked=m).collect())) for m in (4096, 7))
    assert one == many and len(one) == 300


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [9.0, 9.0], 2), (1, [1.0, 0.25], 1), (2, [0.9, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [], 1), (9, [1.0, 0.5, 2.0], 1), (10, [0.0, 0.0], 2), (20, [-1.0, -1.0], 1), (30, [0.0, 0.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10, 5)
    assert want and {tuple(r) for r in negatives.mine(df, every=10).collect()} == want
    for c in ("v", "anchor", "windows", "shard", "cluster", "ids", "score", "rank", "slot", "far", "a", "id", "kth"):
        df = df.withColumn(c, F.lit("clash"))
    assert {tuple(r) for r in negatives.mine(df, every=10).collect()} == want
    assert negatives.mine(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        negatives.mine(df, max_lengths=1)
