"""The stages of the pipeline, each judged on its own input by plain Python."""

import corpus_pipeline as cp
import numpy as np
import pytest
import test_linededup
import test_packing
import test_qualityrules
import test_simhash

import __spark_entry__ as entry
from rowkeel.llm import mixing, packing
from rowkeel.llm.common import save


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """name -> (input, output)"""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, f in cp.STAGES:
        new = save(f(spark, docs, sf_dir))
        out[name] = docs, new
        docs = new
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name


def test_quality(stages, spark, sf_dir):
    before, after = map(rows, stages["quality_rules"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for i, t in before.items():
        n, _, _, _, again = test_qualityrules.plain_counts(t or "")
        failed = n < 20 or 100 * again > 30 * n
        if failed:
            assert i not in after
    clean = [i for i, y in labels.items() if y == 1 and i in before and (c := test_qualityrules.plain_counts(before[i] or ""))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)
    assert all(before[i] == t for i, t in after.items())


def test_lines(stages):
    before, after = map(rows, stages["line_dedup"])
    assert {i: t or "" for i, t in after.items()} == {i: t for i, (t, _, _) in test_linededup.plain(list(before.items())).items()}


def test_near(stages):
    """One document of each group that five-word sets of a similarity of 0.8 or more link, by all pairs."""
    before, after = map(rows, stages["near_dedup"])
    sets, low = {i: test_simhash.shingle_set(t) for i, t in before.items()}, {i: i for i in before}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(before)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    assert set(after) == {i for i in ids if root(i) == i}
    assert all(before[i] == t for i, t in after.items())


def test_mix(stages):
    before, after = stages["mix_sources"]
    src = {r.doc_id: (r.source, len((r.text or "").split())) for r in before.collect()}
    sizes, taken = {}, {}
    for s, n in src.values():
        sizes[s] = sizes.get(s, 0) + n
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + src[r.doc_id][1]
    targets = mixing.fair_targets(sizes, mixing.cycling_weights(sizes))
    biggest = max(n for _, n in src.values())
    assert all(abs(taken.get(s, 0) - t) <= biggest for s, t in targets.items())


def test_pack(stages):
    before, after = stages["pack_sequences"]
    whole = test_packing.tokenizers.Tokenizer.from_file(cp.tokenizer_path())
    want = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    got = after.collect()
    assert sum(r.length for r in got) == want and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_packing_keeps_small_caches():
    """What a worker keeps after packing stays below 50,000 chunks and 20,000 stems, with the tokenizer's ids."""
    path, words = cp.tokenizer_path(), [f"{'abcdefghij'[n % 10]}{''.join(chr(97 + int(d)) for d in str(n))}" for n in range(150_000)]
    own, whole = packing.WordTokens(path, cp.ROOM), test_packing.tokenizers.Tokenizer.from_file(path)
    texts = [" ".join(words[i : i + 5_000]) for i in range(0, len(words), 5_000)]
    got = [own.encode([t])[0] for t in texts]
    assert got[::10] == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[::10]]
    assert len(own.chunks) < 50_000 and len(own.stems) < 20_000


def test_stages_pack_with_that_room(stages, spark, sf_dir, monkeypatch):
    """The stage passes it on, and its rows are those of full caches."""
    rooms, cut = [], packing.cut_pieces
    monkeypatch.setattr(packing, "cut_pieces", lambda *a: rooms.append(a[-1]) or cut(*a))
    before, after = stages["pack_sequences"]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = packing.pack(before, cp.tokenizer_path()).select(*cols)
    cp.pack_sequences(spark, before, sf_dir)
    assert rooms == [1.0, cp.ROOM] and full.exceptAll(after.select(*cols)).isEmpty() and full.count() == after.count()


def test_mixing_starts_no_other_workers(stages, spark, sf_dir):
    """Rows of the driver reach the plan without an RDD, whose Python workers would stay beside the operators' own."""
    out = cp.mix_sources(spark, stages["mix_sources"][0], sf_dir)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()


def test_registered():
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13


def test_odd(spark, clashing, no_docs, sf_dir):
    """Columns named like those that stages use inside come out as they went in, and so do nulls, repeats and long texts."""
    names = [c for c in clashing.columns if c not in ("text", "n_chars")]
    had = {tuple(map(str, r)) for r in clashing.select(*[f"`{n}`" for n in names]).collect()}
    for name, f in cp.STAGES[:-1]:
        out = f(spark, clashing, sf_dir)
        assert out.dtypes == clashing.dtypes, name
        assert {tuple(map(str, r)) for r in out.select(*[f"`{n}`" for n in names]).collect()} <= had, name
    cp.STAGES[-1][1](spark, clashing, sf_dir).collect()
    for _, f in cp.STAGES:
        assert f(spark, no_docs, sf_dir).count() == 0
