"""Edge semantics of the audits on small tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowkeel import CardinalityRule, FkRule, NullMeaning, TableCatalog
from rowkeel import operators as ops
from rowkeel.functions import one_decimal, percent
from rowkeel.operators.nulls import meaning_of
from rowkeel.report import cardinality_lines, fk_lines, inventory_lines, null_lines, report, write_report
from rowkeel.rules import ENTERPRISE_CARDINALITY, ENTERPRISE_FK, ENTERPRISE_NULLS


def frame(spark, values, schema):
    return spark.createDataFrame([(v,) for v in values], schema)


def fk(spark, child, ref, child_type="int", ref_type="int", check=ops.fk_check):
    t = TableCatalog({"c": frame(spark, child, f"fk {child_type}"), "r": frame(spark, ref, f"k {ref_type}")})
    return [(r.refs, r.orphans, r.status) for r in check(t, [FkRule("X", "c", "fk", "r", "k")]).collect()]


both_forms = pytest.mark.parametrize("check", [ops.fk_check_joins, ops.fk_check_long])


@both_forms
@pytest.mark.parametrize(
    "child, ref, types, want",
    [
        ([1, 1, 5, None], [1, 2], ("int", "int"), (2, 1, "1 orphans")),
        ([None, None], [1], ("int", "int"), (0, 0, "OK")),
        ([], [1], ("int", "int"), (0, 0, "OK")),
        ([1, 2], [], ("int", "int"), (2, 2, "2 orphans")),
        ([float("nan"), None, 1.0], [1.0, float("nan")], ("double", "double"), (1, 0, "OK")),
        ([1.0, 2.5], [1, 2], ("double", "int"), (2, 1, "1 orphans")),
        (["1", "x"], [1], ("string", "int"), (2, 2, "2 orphans")),
        ([True], [1], ("boolean", "int"), (1, 0, "OK")),
        (["A", "a", "a "], ["a"], ("string", "string"), (3, 2, "2 orphans")),
    ],
)
def test_fk_cases(spark, check, child, ref, types, want):
    assert fk(spark, child, ref, *types, check=check) == [want]


def test_fk_mixed_kinds(spark):
    child = spark.createDataFrame([(("n", "1"),), (("s", "1"),), (("s", "x"),)], "fk struct<kind:string,text:string>")
    t = TableCatalog({"c": child, "r": frame(spark, [1], "k int")})
    (r,) = ops.fk_check(t, [FkRule("X", "c", "fk", "r", "k")]).collect()
    assert (r.refs, r.orphans) == (3, 2)


def test_fk_missing_objects(spark):
    t = TableCatalog({"c": frame(spark, [1], "fk int"), "r": frame(spark, [1], "k int")})
    good, gone = FkRule("A", "c", "fk", "r", "k"), FkRule("B", "c", "other", "r", "k")
    assert [r.rule_id for r in ops.fk_check(t, [gone, good]).collect()] == ["A"]
    assert ops.skipped_rules(t, [gone, good]) == [gone]
    for bad in (FkRule("C", "no", "fk", "r", "k"), FkRule("D", "c", "fk", "no", "k"), FkRule("E", "c", "fk", "r", "no")):
        with pytest.raises(KeyError):
            ops.fk_check(t, [bad])
    with pytest.raises(ValueError):
        ops.fk_check(t, [gone])


def test_orphans_listed(spark):
    t = TableCatalog({"c": spark.createDataFrame([(1, "a"), (9, "b"), (9, "c"), (None, "d")], "fk int, v string"), "r": frame(spark, [1], "k long")})
    rule = FkRule("X", "c", "fk", "r", "k")
    assert [r.key for r in ops.orphan_keys(t, rule).collect()] == [9]
    assert sorted(r.v for r in ops.orphan_rows(t, rule).collect()) == ["b", "c"]


def test_cardinality(spark):
    t = TableCatalog({"p": frame(spark, [1, 2, 3, 3, None], "k int"), "c": frame(spark, [1, 1, 9, None], "fk int"), "e": frame(spark, [None], "fk int")})
    rules = [CardinalityRule("A", "p", "k", "c", "fk"), CardinalityRule("B", "p", "k", "none", "fk"), CardinalityRule("C", "p", "k", "e", "fk", "N ↔ N")]
    got = [(r.rule_id, r.declared, r.n_parents, r.avg_children, r.min_children, r.max_children) for r in ops.cardinality_profile(t, rules).collect()]
    assert got == [("A", "1 → N", 3, 1.5, 1, 2), ("C", "N ↔ N", 3, None, None, None)]
    with pytest.raises(KeyError):
        ops.cardinality_profile(t, [CardinalityRule("D", "p", "no", "c", "fk")])
    assert cardinality_lines(ops.cardinality_profile(t, rules)).where("ordinal = 2").first().line.endswith("avg nan, min nan, max nan")


def test_cardinality_of_any_kind_of_key(spark):
    """Keys are told apart within their column only; a shared parent is read once."""
    kinds = {"string": ["1", "1.0", "1"], "double": [0.0, -0.0, float("nan")], "boolean": [True, False, True], "binary": [b"a", b"b", b"a"], "array<int>": [[1], [1, None], [1]]}
    want = {"string": (2, 1.5, 1, 2), "double": (1, 2.0, 2, 2), "boolean": (2, 1.5, 1, 2), "binary": (2, 1.5, 1, 2), "array<int>": (2, 1.5, 1, 2)}
    t = TableCatalog({k: frame(spark, [*v, None], f"k {k}") for k, v in kinds.items()} | {"p": frame(spark, [1, 2, 2, 1000], "k long")})
    got = ops.cardinality_profile(t, [CardinalityRule(k, "p", "k", k, "k") for k in kinds] + [CardinalityRule(f"{k} up", k, "k", "p", "k") for k in kinds])
    rows = {r.rule_id: (r.n_parents, r.avg_children, r.min_children, r.max_children) for r in got.collect()}
    for k, (n, *rest) in want.items():
        assert rows[k] == (3, *rest) and rows[f"{k} up"] == (n, 4 / 3, 1, 2)


def test_null_profile(spark):
    df = spark.createDataFrame([(float("nan"), None, "x", [1]), (None, None, "", None), (1.0, None, "NA", [])], "v double, w int, s string, a array<int>")
    empty = spark.createDataFrame([], "z int")
    t = TableCatalog({"H/t": df, "H/e": empty})
    got = [(r.table_name, r.column_name, r.n_null, r.n_rows, r.pct_null) for r in ops.null_profile(t).orderBy("ordinal", "column_ordinal").collect()]
    assert got == [("H/t", "v", 2, 3, 66.7), ("H/t", "w", 3, 3, 100.0), ("H/t", "a", 1, 3, 33.3)]
    full = ops.null_profile(t, all_columns=True).where("table_name = 'H/e'").collect()
    assert [(r.n_null, r.n_rows, r.pct_null) for r in full] == [(0, 0, None)]
    assert null_lines(ops.null_profile(t)).count() == 3


def test_null_meanings(spark):
    t = TableCatalog({"RH/employees": spark.createDataFrame([(None, None, None)], "manager_id int, notes string, other int")})
    got = {r.column_name: r.meaning for r in ops.annotate_nulls(ops.null_profile(t), ENTERPRISE_NULLS).collect()}
    assert got == {"manager_id": "top manager", "notes": "no comment", "other": None}
    both = [NullMeaning("*.a", "any"), NullMeaning("t.a", "this")]
    assert [meaning_of(x, "a", both) for x in ("S/t", "S/u")] == ["this", "any"]


def test_inventory(spark):
    t = TableCatalog({"A/x": frame(spark, [None, None], "k int"), "A/y": frame(spark, [], "k int")})
    assert [(r.table_name, r.n_rows, r.n_cols) for r in ops.table_inventory(t).orderBy("ordinal").collect()] == [("A/x", 2, 1), ("A/y", 0, 1)]
    assert inventory_lines(ops.table_inventory(t)).count() == 2


def test_catalog(spark):
    t = TableCatalog({"a": frame(spark, [1], "k int"), "b": frame(spark, [1], "k int")})
    t.register("a", frame(spark, [1, 2], "k int"), view=True)
    assert list(t) == ["a", "b"] and t.require("a").count() == 2 and t.find("no") is None
    assert spark.table("a").count() == 2
    with pytest.raises(KeyError):
        t.require("no")


def test_rule_packs(spark):
    assert (len(ENTERPRISE_FK), len(ENTERPRISE_CARDINALITY), len(ENTERPRISE_NULLS)) == (22, 20, 5)
    tables = {x for r in ENTERPRISE_FK for x in (r.child_table, r.ref_table)} | {x for r in ENTERPRISE_CARDINALITY for x in (r.parent_table, r.child_table)}
    assert len(tables) == 24
    # Every rule of both packs runs on a catalog with the columns that they name.
    columns = {}
    for r in ENTERPRISE_FK:
        columns.setdefault(r.child_table, set()).add(r.child_column)
        columns.setdefault(r.ref_table, set()).add(r.ref_column)
    for r in ENTERPRISE_CARDINALITY:
        columns.setdefault(r.parent_table, set()).add(r.parent_column)
        columns.setdefault(r.child_table, set()).add(r.child_column)
    t = TableCatalog({n: spark.range(3).select(*[F.col("id").alias(c) for c in sorted(cs)]) for n, cs in sorted(columns.items())})
    assert [(r.rule_id, r.refs, r.orphans) for r in ops.fk_check_long(t, ENTERPRISE_FK).orderBy("ordinal").collect()] == [(r.rule_id, 3, 0) for r in ENTERPRISE_FK]
    assert ops.cardinality_profile(t, ENTERPRISE_CARDINALITY).where("n_parents = 3 and avg_children = 1").count() == 20
    assert fk_lines(ops.fk_check(t, ENTERPRISE_FK[:2])).count() == 2


def test_percent_ties(spark):
    df = spark.createDataFrame([(1, 16), (5, 16), (13, 16), (0, 0)], "n long, m long")
    assert [r.p for r in df.select(percent(F.col("n"), F.col("m")).alias("p")).collect()] == [6.2, 31.2, 81.2, None]


keys = st.lists(st.one_of(st.none(), st.integers(-3, 6)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(child=keys, ref=keys)
def test_fk_property(spark, child, ref):
    own, target = {x for x in child if x is not None}, {x for x in ref if x is not None}
    n = len(own - target)
    assert fk(spark, child, ref) == [(len(own), n, "OK" if n == 0 else f"{n} orphans")]


def test_one_decimal(spark):
    """As the exact value of the double rounds, ties to even."""
    import random

    draw = random.Random(5)
    values = [0.0, -0.0, 0.05, 0.25, 0.75, 1.45, 1.85, 2.35, 0.95, 9.95, 99.95, 1e9 + 0.25, -1.25, -0.04, 1 / 3, float("inf"), float("-inf"), 123456789.05]
    values += [k / 20 for k in range(-300, 300)] + [draw.random() * 10 ** draw.randint(0, 9) for _ in range(2000)] + [round(draw.random() * 100, 2) for _ in range(2000)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", one_decimal(F.col("v")).alias("t")).orderBy("i").collect()
    assert [(v, r.t) for v, r in zip(values, got)] == [(v, f"{v:.1f}") for v in values]
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(one_decimal(F.col("v")).alias("t")).collect()
    assert [r.t for r in none] == ["nan", "nan"]


def test_report_file_keeps_the_order(spark, tmp_path):
    t = TableCatalog({n: frame(spark, [None, 1], "k int") for n in ("b", "a", "c")})
    write_report(report(inventory_lines(ops.table_inventory(t)), null_lines(ops.null_profile(t))), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*.txt")))
    assert text.splitlines() == [f"{n:<45} {2:>5} rows {1:>2} columns" for n in "bac"] + [f"{n}.k: 1 null (50.0 %)" for n in "bac"]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_results_are_kept(spark, tmp_path, fmt):
    from rowkeel.report import write_results

    t = TableCatalog({"c": frame(spark, [1, 5], "fk int"), "r": frame(spark, [1], "k int")})
    write_results(ops.fk_check(t, [FkRule("X", "c", "fk", "r", "k")]), str(tmp_path / fmt), fmt)
    (r,) = spark.read.format(fmt).load(str(tmp_path / fmt)).collect()
    assert (r.refs, r.orphans, r.status) == (2, 1, "1 orphans")
