import random
import re

import xxhash
from pyspark.sql import functions as F

from rowkeel.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget=2):
    """fp -> smallest fp of its component."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(rng, n, centres):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \n", "a", "A b", "a b c", "É É x\x85y z", "x " * 500]
    texts += [" ".join(rng.choice("abc de F Gh İ ß".split()) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]
    assert simhash.fingerprint(b"x y z " * 30_000) == brute_fingerprint("x y z " * 30_000)


def _same_partition(links, fps, budget):
    want = brute_components(fps, budget)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for r in links.collect():
        a, b = r.src & mask, r.dst & mask
        assert want[a] == want[b]
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {f: root(f) for f in fps} == want


def test_trie_links(spark):
    fps = clustered(random.Random(2), 700, 12) + [0, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    for budget in (1, 2, 3):
        _same_partition(simhash.trie_links(df, budget), set(fps), budget)


def test_hot_subtrees_are_split(spark):
    # One tight cluster: every block is shared by most fingerprints, so node pairs are expanded down the trie.
    fps = clustered(random.Random(3), 300, 1)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    _same_partition(simhash.trie_links(df, 2, max_task=40), set(fps), 2)


def test_components(spark):
    rng = random.Random(6)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1, 2), (2, 3), (3, 1), (7, 7), (9, 8), (8, 9)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    got = {n: got.get(n, n) for n in [*path, 1, 2, 3, 8, 9]}
    assert got == {**{n: 100 for n in path}, 1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_near_duplicates(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    texts = [t if k == 0 else t + f" tail{k}" for t in base for k in range(4)] + ["", None, " "]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    fp = {100 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(fp.values())
    least = {}
    for d, f in fp.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    assert {r.doc_id: (r.fp & ((1 << 64) - 1), r.component_id) for r in got} == {d: (f, least[comp[f]]) for d, f in fp.items()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(least.values())


def test_odd(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert [r.component_id for r in got if r.doc_id is None and r.fp != 0] == [None]
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    kept = out.collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 5, 6, 8]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0
    assert spark.range(1).select(simhash.fp_hex(F.lit(10).cast("long")).alias("x")).first().x == "000000000000000a"


def near_copies(rng, n):
    """n texts of 60 to 300 words and a copy of each in which a run of words is replaced."""
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        copy, k = list(words), rng.randint(1, max(1, len(words) // 12 - 4))
        at = rng.randrange(len(words) - k)
        copy[at : at + k] = [f"new{rng.randrange(5000)}" for _ in range(k)]
        out.append((" ".join(words), " ".join(copy)))
    return out


def shingle_set(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_near_copies_recall(spark):
    pairs = [p for p in near_copies(random.Random(11), 400) if jaccard(*p) >= 0.8]
    wide = [p for p in pairs if (brute_fingerprint(p[0]) ^ brute_fingerprint(p[1])).bit_count() > 2]
    assert len(pairs) > 300 and len(wide) > 200
    far = [(a, " ".join(a.split()[: len(a.split()) // 2])) for a, _ in near_copies(random.Random(12), 50)]  # half a text isn't a near copy
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs + far) for k, t in enumerate(p)], "doc_id long, text string").repartition(3)
    for options in ({}, {"max_task": 60}):
        kept = {r.doc_id for r in simhash.drop_near_copies(docs, **options).collect()}
        assert kept >= {2 * i for i in range(len(pairs + far))} | {2 * i + 1 for i in range(len(pairs), len(pairs + far))}
        assert sum(2 * i + 1 not in kept for i in range(len(pairs))) >= 0.99 * len(pairs)


def test_large_group_of_near_copies(spark):
    # Each differs from all others in one word: more candidates than a round takes, one component.
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*base[:i], "odd", *base[i + 1 :]])) for i in range(200)] + [(None, " ".join(base)), (500, "other words")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {0, 500}


def roots_of_all_pairs(texts):
    """The smallest index of each text's component over all pairs of a similarity of 0.8 or more."""
    sets, low = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return [root(i) for i in range(len(texts))]


def test_table_against_all_pairs(spark, sf_dir):
    """Every document of the smallest table, some of them just at the similarity, none lost and none linked too much."""
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = {rows[i].doc_id for i, r in enumerate(roots_of_all_pairs([r.text for r in rows])) if i == r}
    got = simhash.drop_near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id for r in got.collect()} == want and len(want) < len(rows)


def test_bands_lose_few_pairs():
    """Sets of similarity 0.8, of 5 to 2,000 shingles: 1 in 5,000 shares no band, and hardly one differs too much."""
    rng, lost, n = random.Random(5), 0, 2000
    for i in range(n):
        size = 5 * rng.choice((1, 2, 4, 10, 40, 400 if i % 10 == 0 else 20))
        words = [f"{i}-{k}" for k in range(size)]
        gone = size - 4 * size // 5  # J = 0.8 by leaving a fifth out
        a, b = (simhash._sketch(" ".join(w).encode(), 1) for w in (words, words[gone:]))
        assert a[3] == size and b[3] == size - gone
        near = (a[1] ^ b[1]).bit_count() <= 24 and (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() <= 48
        lost += not (near and (a[4] == b[4]).any())
    assert lost <= 0.002 * n


def test_crowded_group_against_all_pairs(spark):
    """Edited copies of one text, of which few are similar enough: all have more candidates than are confirmed by text."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(150)]

    def edited():
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, 8)):
            words[at] = f"n{rng.randrange(9999)}"
        return " ".join(words)

    texts = [edited() for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i for i, r in enumerate(roots_of_all_pairs(texts)) if r == i}
    assert 5 < len(want) < 150
    for options in ({}, {"max_task": 300}, {"max_task": 40}):  # 40: bands of more sets than a task takes
        assert {r.doc_id for r in simhash.drop_near_copies(docs, **options).collect()} == want


def test_near_copies_odd(spark, odd_docs, no_docs):
    out = simhash.drop_near_copies(odd_docs)
    assert out.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5, 6, 8]
    assert simhash.drop_near_copies(no_docs).count() == 0
