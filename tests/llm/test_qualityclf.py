import numpy as np

from rowkeel.llm import qualityclf
from rowkeel.llm.queries import op9_qualityclf


def test_ftrl_is_the_minimum_of_its_sums():
    """With one coordinate the closed form must minimise z w + l1 |w| + (rate + l2) w² / 2."""
    m = qualityclf.Ftrl(1)
    for x, y in ((1.0, 1), (0.5, 0), (1.0, 1)):
        m.update(np.array([0]), np.array([x]), y)
    for k in range(2):
        rate = (m.beta + np.sqrt(m.n[k])) / m.alpha + m.l2
        w = np.linspace(-3, 3, 60_001)
        assert abs(w[np.argmin(m.z[k] * w + m.l1 * np.abs(w) + rate * w * w / 2)] - m.weights()[k]) < 2e-4


def plain_ftrl(rows, bits, epochs, seed, alpha=0.5, beta=1.0, l1=0.01, l2=0.1):
    """FTRL-proximal over dicts: slot -> sums."""
    import math

    z, n = {}, {}

    def weight(i):
        a, b = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    share = [sum(y == k for _, y in rows) for k in (0, 1)]
    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(len(rows)):
            data, y = rows[i]
            own = {}
            for s in qualityclf.slots(data, bits).tolist():
                own[s] = own.get(s, 0) + 1
            x = {s: math.sqrt(c) for s, c in own.items()}
            length = max(1e-12, math.sqrt(sum(v * v for v in x.values())))
            x = {s: v / length for s, v in x.items()} | {1 << bits: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(s) * v for s, v in x.items())))
            for s, v in x.items():
                g, w = len(rows) / (2 * share[y]) * (p - y) * v, weight(s)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(n.get(s, 0.0) + g * g) - math.sqrt(n.get(s, 0.0))) / alpha * w
                n[s] = n.get(s, 0.0) + g * g
    return [weight(i) for i in range((1 << bits) + 1)]


def test_training_and_scores_equal_plain_dicts(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("good plain words", "BUY now !!", "the of", "x1 x1 x1")[y::2]) for _ in range(rng.randint(0, 12))), y) for i in range(40) for y in [rng.randint(0, 1)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    w = qualityclf.train(df, bits=9, epochs=2, seed=31)
    want = plain_ftrl([(t.encode(), y) for _, t, y in rows], 9, 2, 31)
    assert np.allclose(w, want, atol=1e-5)
    got = {r.doc_id: r.score for r in qualityclf.score(df, w).collect()}
    for i, t, _ in rows:
        own = {}
        for s in qualityclf.slots(t.encode(), 9).tolist():
            own[s] = own.get(s, 0) + 1
        length = max(1e-12, sum(own.values()) ** 0.5)
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(want[s] * c**0.5 for s, c in own.items()) / length + want[-1])))) < 1e-5


def test_vector():
    at, x = qualityclf.vector("Über the the x".encode(), 12)
    assert np.isclose(np.linalg.norm(x), 1) and len(set(at)) == len(at) and at.max() < 1 << 12
    assert len(qualityclf.vector(b" \n", 12)[0]) == 0


def test_held_out(spark):
    dir_ = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{dir_}/labels.parquet").collect()}
    got = op9_qualityclf(spark, dir_).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.95 * len(good)


def test_odd(spark, odd_docs, no_docs):
    sample = odd_docs.selectExpr("doc_id", "text", "int(doc_id % 2) as label").where("label is not null")
    w = qualityclf.train(sample, bits=10)
    rows = qualityclf.score(odd_docs, w).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (1, 2, 3)]
    assert len(set(empty)) == 1
    zero = qualityclf.train(no_docs.selectExpr("doc_id", "text", "1 as label"), bits=10)
    assert not zero.any() and {r.score for r in qualityclf.score(odd_docs, zero).collect()} == {0.5}
    assert qualityclf.score(no_docs, w).count() == 0
