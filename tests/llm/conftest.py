import pytest

#: A text of over a million characters on one line.
LONG = "alpha beta gamma delta " * 45_000
#: Columns whose names the operators use inside or return.
CLASH = {"size": 7, "h": 1, "fp": 2, "key": 3, "score": 0.5, "kept": True, "n_words": 4, "n_lines": 5, "component_id": 6, "spans": "x", "pattern": "y", "part": 8, "length": 9}
#: More of them: every name that an operator or a stage gives a column on the way or returns.
INSIDE = (
    "row r s q sig more root comp first cut loses maybe payload repeats taken target source_size sources tie time extra bucket edge bits passes rest take n m at x y err rank group of digest drop label words "
    "_key _of _drop _cut _n _row _fp _sig _more _s _q _rows _b _at _map _byte _hit _slot n_dropped content_share base_failed word_chars n_symbols n_dup_lines n_repeat_words predicted found n_spans n_email n_secret base_spans "
    "lang_pred held_out piece start ids_crc32 sequence_id offset local fingerprint with.dot"
).split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, repeated rows, null ids and other nulls, and clashing columns."""
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "Ünïcode ñandú 日本語 words here"), (6, "same line of text\nother words"), (6, "same line of text\nother words"), (7, "same line of text\nother words"), (None, "no id but words"), (None, None), (8, "\x00\x1c odd \x85 controls")]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None if t is None else len(t), *CLASH.values()) for n, (i, t) in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size int, h int, fp int, key int, score double, kept boolean, n_words int, n_lines int, component_id int, spans string, pattern string, part int, length int"
    return spark.createDataFrame(rows, kinds).coalesce(2)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """odd_docs with a column for each name of INSIDE, which holds the row's own text."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.substring("text", 1, 9), F.lit("none"))).alias(n) for n in INSIDE])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
