from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeel.llm import whitening
from rowkeel.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x)]
    mid = [[Fraction(v) - Fraction(s, n) for v, s in zip(r, sums)] for r in x]
    d = len(sums)
    return np.array([[float(sum(r[i] * r[j] for r in mid) / n) for j in range(d)] for i in range(d)])


def integers(rows):
    return [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]


def found(df, **options):
    out = {}
    for r in whitening.whiten(df, **options).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_outer_products_are_exact():
    """Sums of outer products of mixed sizes equal those of fractions to double-double precision."""
    rng = np.random.default_rng(2)
    high = rng.normal(size=(2500, 5)) * 10.0 ** np.array([0, 8, -7, 3, 0])
    high[:, 4] = 0
    low = high * 2.0**-60 * rng.normal(size=high.shape)
    g = whitening.Gram(5)
    g.put(high, low)
    for i in range(5):
        for j in range(5):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j]))
            size = sum(abs(Fraction(a) * Fraction(c)) for a, c in zip(high[:, i], high[:, j]))
            assert abs(Fraction(g.high[i, j]) + Fraction(g.low[i, j]) - want) <= size * Fraction(1, 2**90)


def test_two_sum():
    s, e = whitening.two_sum(np.array([1e16, 1.0]), np.array([1.0, 2.0**-60]))
    assert [Fraction(a) + Fraction(b) for a, b in zip(s, e)] == [10**16 + 1, 1 + Fraction(1, 2**60)]


@pytest.mark.parametrize("run", [8192, 12])
def test_equals_exact_covariance(spark, monkeypatch, run):
    monkeypatch.setattr(whitening, "_RUN", run)  # 12: the matrix in three parts
    rng = np.random.default_rng(1)
    rows = [(i, (x * [3, 1, 0.5, 2, 0.1, 1]).tolist()) for i, x in enumerate(rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)))]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(5), components=4)
    x = integers(rows)
    e, q = np.linalg.eigh(exact_covariance(x))
    e, q = e[::-1], q[:, ::-1]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    mid = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(r, sums)] for r in x])
    for k in range(4):
        own = np.array([got[i][k + 1].whitened for i in range(n)])
        want = mid @ q[:, k] / np.sqrt(e[k])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
        assert got[0][k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-12)
    for i in range(n):
        assert int(got[i][1].deviation) == sum((n * v - s) ** 2 for v, s in zip(x[i], sums)) and got[i][1].n == n and len(got[i]) == 4
    assert 0 <= got[0][1].identity_error < 1e-10


def test_query(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = op11_whitening(spark, sf_dir).collect()
    assert len(got) == 32 * len(rows) and {r.component for r in got} == set(range(1, 33))
    w = np.zeros((len(rows), 32))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    cov = np.cov(w.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-10 and got[0].identity_error < 1e-10
    x = integers(sorted(rows.items()))
    v = exact_covariance(x)
    e = np.linalg.eigvalsh(v)[::-1]
    assert max(abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) for r in got) < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i % 7, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 3)))]  # repeated ids
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [1.0, float("inf"), 2.0]), (54, [])]
    other = [(60, [1.0, 2.0]), (61, [1.0, 3.0]), (62, [2.0, 2.0])]  # a length of its own
    alone = [(None, [5.0])]
    df = spark.createDataFrame(good + good[:3] + odd + other + alone, SCHEMA)
    for c in ("x", "dim", "i", "z", "n", "component", "own", "high", "whitened"):
        df = df.withColumn(c, F.lit("clash"))
    rows = whitening.whiten(df).collect()
    assert {(r.vec_id, r.n) for r in rows} == {(i, 43) for i in range(7)} | {(60, 3), (61, 3), (62, 3), (None, 1)}
    assert len(rows) == 43 * 3 + 3 * 2 + 1
    (one,) = [r for r in rows if r.vec_id is None]
    assert (one.component, one.whitened, one.explained, one.deviation, one.identity_error) == (1, None, 0.0, 0, 0.0)
    assert whitening.whiten(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(df, max_lengths=2)
    with pytest.raises(ValueError):
        whitening.whiten(df, max_dim=2)


def test_dependent_and_huge_entries(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 7.0, float(i % 3)]) for i in range(30)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert [got[1][k].whitened is None for k in (1, 2, 3, 4)] == [False, False, True, True]
    assert [got[1][k].explained > 0 for k in (1, 2, 3, 4)] == [True, True, False, False] and got[0][1].identity_error < 1e-12
    huge = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(8)]
    far = found(spark.createDataFrame(huge, SCHEMA))
    assert all(int(far[i][1].deviation) > 10**26 and far[i][1].whitened is not None for i in range(8))


def test_deviation_is_exact_in_both_ways():
    x = np.array([[1_000_003, 999_990], [1_000_000, 1_000_001], [5, 3_000_000_000_000]], np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    m = whitening.Model(3, sums, *[np.zeros(0)] * 3)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert m.deviation(x) == want
    big = whitening.Model(10**12, [s * 10**12 // 3 for s in sums], *[np.zeros(0)] * 3)
    assert big.deviation(x) == [sum((10**12 * int(v) - s * 10**12 // 3) ** 2 for v, s in zip(r, sums)) for r in x]
