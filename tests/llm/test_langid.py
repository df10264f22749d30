import numpy as np

from rowkeel.llm import langid
from rowkeel.llm.queries import op3_langid


def test_ngrams_are_one_a_letter():
    texts = ["Ab, cd", "", "x", "12 !", "a\0b", "𝒳y", "😀😀 123"]
    grams, ends = langid._ngrams(texts)
    per = np.diff(np.r_[0, ends])
    assert per.tolist() == [4, 0, 1, 0, 2, 2, 0] and len(grams) == ends[-1]
    # No n-gram sees another text.
    for t in texts:
        own, _ = langid._ngrams([t])
        at = texts.index(t)
        assert own.tolist() == grams[ends[at] - per[at] : ends[at]].tolist()


def plain_ngrams(text):
    """Four UTF-16 units around each letter, others than letters as one blank, by plain Python."""
    out, units = [], []
    for c in text.lower():
        if c.isalpha():
            code = c.encode("utf-16-le")
            units += [(int.from_bytes(code[i : i + 2], "little"), i == 0) for i in range(0, len(code), 2)]
        else:
            units += [(0, False)] if units and units[-1][0] else []
    units = [(0, False)] + units + [(0, False)] * 2
    for i, (_, counts) in enumerate(units):
        if counts:
            out.append(tuple(u for u, _ in units[i - 1 : i + 3]))
    return out


def plain_model(rows, min_rate=1e-5, contrast=8.0):
    """lang -> set of n-grams."""
    from collections import Counter

    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    counts = {k: c for k, c in counts.items() if c}
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    top = {}
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(x, top.get(g, 0))
    return {k: {g for g, x in r.items() if x >= min_rate and x * contrast >= top[g]} for k, r in rates.items()}


def test_equals_plain_sets(spark, sf_dir):
    """Sets in place of filters predict the same, but for a filter's false positives."""
    from rowkeel.llm.common import crc_mod

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where((crc_mod(docs.doc_id, 3) != 1) & docs.lang.isNotNull() & docs.text.isNotNull())
    model = plain_model([(r.lang, r.text) for r in learn.collect()])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    differ = 0
    for r in op3_langid(spark, sf_dir).collect():
        grams = plain_ngrams(texts[r.doc_id])
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        hits = {k: sum(g in own for g in grams) for k, own in sorted(model.items())}
        best = max(hits, key=hits.get)
        assert abs(r.score - hits[r.lang_pred] / len(grams)) < 0.02
        differ += r.lang_pred != best
    assert differ <= 0.01 * len(texts)


def test_symbols_are_no_letters(spark):
    rows = [(1, "😀😀 123"), (2, "123"), (3, "😀 the 12"), (4, "𝒳𝒴𝒵"), (5, "the")]
    model = langid.train(spark.createDataFrame([("en", "the the"), ("xx", "𝒳𝒴𝒵")], "lang string, text string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[4][0] == "xx" and got[3] == got[5] and got[5] == ("en", 1.0)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = op3_langid(spark, sf_dir).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"en"}
    assert langid.train(no_docs) is None
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_many_languages(spark):
    """More languages than one mask word has bits, and a tie that code points decide."""
    rows = [(f"l{i:03}", f"{chr(0x4E00 + 8 * i)}{chr(0x4E01 + 8 * i)}{chr(0x4E02 + 8 * i)} " * 5) for i in range(70)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    langs, score = model.predict([t for _, t in rows])
    assert langs == [x for x, _ in rows] and score.min() > 0.9
    twin = langid.train(spark.createDataFrame([("b", "abc abd"), ("a", "abc abd")], "lang string, text string"))
    assert twin.predict(["abc"])[0] == ["a"]
