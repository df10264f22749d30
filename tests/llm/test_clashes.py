"""Columns of the user's that are named like those the operators use inside or return."""

import numpy as np
import pytest
from conftest import CLASH, INSIDE

from rowkeel.llm import linededup, mixing, pii, qualityclf, qualityrules, simhash

WIDE = [*CLASH, *INSIDE]


def values(df, names):
    return sorted(tuple(map(str, (r[n] for n in names))) for r in df.select(*[f"`{n}`" for n in names]).collect())


@pytest.mark.parametrize(
    "stage",
    [lambda d: qualityrules.keep_good(d, None, min_words=0, max_repeat=100, min_share=-1.0), linededup.drop_lines, simhash.drop_near_copies, simhash.drop_near_duplicates, mixing.repeat_documents],
    ids=["keep_good", "drop_lines", "drop_near_copies", "drop_near_duplicates", "repeat_documents"],
)
def test_rows_keep_all_their_values(clashing, stage):
    out = stage(clashing)
    assert out.dtypes == clashing.dtypes
    names = [c for c in clashing.columns if c != "text"]
    before, after = values(clashing, names), values(out, names)
    assert after and set(after) <= set(before)
    if stage is linededup.drop_lines or "lambda" in stage.__name__:
        assert after == before


@pytest.mark.parametrize(
    "operator, new",
    [
        (lambda d: qualityrules.assess(d, None), "n_words word_chars n_symbols n_dup_lines n_repeat_words content_share base_failed kept"),
        (linededup.dedup_lines, "n_lines n_dropped"),
        (pii.detect, "n_email n_ip n_card n_phone n_account n_secret n_login n_spans found base_spans spans"),
        (lambda d: qualityclf.score(d, np.zeros(5)), "score predicted"),
    ],
    ids=["assess", "dedup_lines", "detect", "score"],
)
def test_results_replace_their_own_names_only(clashing, operator, new):
    out = operator(clashing)
    assert sorted(out.columns) == sorted({*clashing.columns, *new.split()})
    names = [c for c in clashing.columns if c not in {"text", *new.split()}]
    assert values(out, names) == values(clashing, names)
    assert not {str(v) for r in out.select(*new.split()).collect() for v in r} & {v for (v,) in values(clashing, ["row"])}


def test_other_operators_read_their_own_columns(clashing):
    assert values(simhash.near_duplicates(clashing), ["fp", "component_id"]) == values(simhash.near_duplicates(clashing.select("doc_id", "text")), ["fp", "component_id"])
    assert values(mixing.mix_documents(clashing), ["doc_id", "size", "taken"]) == values(mixing.mix_documents(clashing.select("doc_id", "text", "source")), ["doc_id", "size", "taken"])
