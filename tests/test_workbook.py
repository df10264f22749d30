import pytest
import xlsx
from pyspark.sql import types as T

from rowkeel import operators as ops
from rowkeel.sources import load_workbooks, read_sheet, sheet_names
from rowkeel.sources.workbook import is_summary

BANNER = ["My table"]


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "rh.xlsx"
    xlsx.write(
        path,
        {
            "📋 Overview": [["x"]],
            "Résumé": [["x"]],
            "employees": [BANNER, ["id", "name", "hired", "rate", "ok", None, "mixed"], [1, "Ann", ("date", 45292), 1.5, True, "u", 1], [2, "N/A", None, 2, False, None, "1"], [3, ("inline", "B <c>"), ("date", 45292.5), ("error", "#DIV/0!"), None, "NA", None]],
            "skills": [BANNER, ["employee_id"], [1], [1], [9]],
            "empty": [BANNER, ["a", "b"]],
            "banner": [BANNER],
            "twice": [BANNER, ["a", "a"], [1, 2]],
        },
    )
    return str(path)


@pytest.mark.parametrize("name, want", [("Resume 2024", True), ("Résumé", True), ("📋x", True), ("employees", False)])
def test_summary(name, want):
    assert is_summary(name) is want


def test_sheets(spark, book):
    assert sheet_names(spark, book) == ["employees", "skills", "empty", "banner", "twice"]
    assert len(sheet_names(spark, book, tables_only=False)) == 7


def test_types(spark, book):
    df = read_sheet(spark, book, "employees")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("hired", "timestamp"), ("rate", "double"), ("ok", "boolean"), ("_c5", "string"), ("mixed", "struct<kind:string,text:string>")]
    rows = df.orderBy("id").collect()
    assert [r.name for r in rows] == ["Ann", None, "B <c>"]
    assert [str(r.hired) for r in rows] == ["2024-01-01 00:00:00", "None", "2024-01-01 12:00:00"]
    assert [r.rate for r in rows] == [1.5, 2.0, None] and [r.ok for r in rows] == [True, False, None]
    assert [r._c5 for r in rows] == ["u", None, None]
    assert [r.mixed and tuple(r.mixed) for r in rows] == [("n", "1"), ("s", "1"), None]


def test_schema(spark, book):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.IntegerType())])
    assert [tuple(r) for r in read_sheet(spark, book, "employees", schema=schema).orderBy("id").collect()] == [("1", None), ("2", None), ("3", None)]


def test_bad_sheets(spark, book):
    assert read_sheet(spark, book, "empty").dtypes == [("a", "string"), ("b", "string")]
    with pytest.raises(ValueError, match="banner"):
        read_sheet(spark, book, "banner")
    with pytest.raises(ValueError, match="repeats"):
        read_sheet(spark, book, "twice")


def test_audit_of_workbooks(spark, tmp_path):
    from rowkeel import FkRule

    path = tmp_path / "a.xlsx"
    xlsx.write(path, {"employees": [BANNER, ["employee_id"], [1], [2]], "skills": [BANNER, ["employee_id"], [1], [1], [9]]})
    t = load_workbooks(spark, {"RH": str(path)})
    assert list(t) == ["RH/employees", "RH/skills"]
    (r,) = ops.fk_check(t, [FkRule("FK20", "RH/skills", "employee_id", "RH/employees", "employee_id")]).collect()
    assert (r.from_column, r.refs, r.orphans) == ("RH/skills.employee_id", 2, 1)


def test_each_book_is_parsed_once(spark, tmp_path):
    """Tables read the parsed cells: books may go once they are loaded. A sheet reads its own part only."""
    paths = {}
    for system in ("RH", "CRM"):
        paths[system] = str(tmp_path / f"{system}.xlsx")
        xlsx.write(paths[system], {"Résumé": [["x"]], "a": [BANNER, ["k", "v"], *[[i, f"{system}{i}"] for i in range(7000)]], "b": [BANNER, ["k"], [1.5], ["x"]]})
    t = load_workbooks(spark, paths)
    for p in paths.values():
        (tmp_path / p).unlink()
    assert list(t) == ["RH/a", "RH/b", "CRM/a", "CRM/b"]
    assert [(r.n_rows, r.n_cols) for r in ops.table_inventory(t).orderBy("ordinal").collect()] == [(7000, 2), (2, 1), (7000, 2), (2, 1)]
    assert {tuple(r) for r in t.require("CRM/a").collect()} == {(i, f"CRM{i}") for i in range(7000)}
    plan = t.require("CRM/b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(book" in plan and "Python" not in plan and "Arrow" not in plan


def test_no_such_sheet(spark, book):
    with pytest.raises(ValueError, match="no sheet 'nowhere'; there are .*employees"):
        read_sheet(spark, book, "nowhere")


def test_no_books(spark):
    assert list(load_workbooks(spark, {})) == []
