"""All registered audit queries over the test tables, and equivalent SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..catalog import TableCatalog
from ..functions import is_missing, percent, qualified_name, status
from ..operators.cardinality import declared_violations
from ..report import cardinality_lines, fk_lines, inventory_lines, null_lines, report, write_report, write_results
from ..rules import ENTERPRISE_CARDINALITY, ENTERPRISE_FK, CardinalityRule, FkRule, NullMeaning, parse_cardinality_rules, parse_fk_rules
from ..shared import shared_dir
from ..sources.parquet_dir import TEST_TABLES, load_directory
from ..sources.workbook import list_sheets, load_workbooks
from ..sources.workbook_sink import sheet_rows, write_workbook
from . import extensions

Query = Callable[[SparkSession, str], DataFrame]

FK_RULES = parse_fk_rules(
    """
    T01 nation.n_regionkey -> region.r_regionkey
    T02 customer.c_nationkey -> nation.n_nationkey
    T03 supplier.s_nationkey -> nation.n_nationkey
    T04 orders.o_custkey -> customer.c_custkey
    T05 lineitem.l_orderkey -> orders.o_orderkey
    T06 lineitem.l_partkey -> part.p_partkey
    T07 lineitem.l_suppkey -> supplier.s_suppkey
    T08 events.user_id -> customer.c_custkey
    T09 labels.doc_id -> documents.doc_id
    """
)
CARDINALITY_RULES = parse_cardinality_rules(
    """
    D01 region.r_regionkey 1:N nation.n_regionkey
    D02 nation.n_nationkey 1:N customer.c_nationkey
    D03 nation.n_nationkey 1:N supplier.s_nationkey
    D04 customer.c_custkey 1:N orders.o_custkey
    D05 orders.o_orderkey N:N lineitem.l_orderkey
    D06 part.p_partkey N:N lineitem.l_partkey
    D07 supplier.s_suppkey 1:N lineitem.l_suppkey
    D08 customer.c_custkey 1:N events.user_id
    D09 documents.doc_id 1:N labels.doc_id
    """
)
#: lineitem against the finished orders only: most keys are then orphans.
PARTIAL = FkRule("P01", "lineitem", "l_orderkey", "orders_f", "o_orderkey")
#: Not a real key: at small scales half the ids have no document.
LOOSE = FkRule("P02", "embeddings", "vec_id", "documents", "doc_id")
MEANINGS = [NullMeaning("documents_labels.quality", "not rated"), NullMeaning("*.toxic", "not screened"), NullMeaning("*.quality", "unknown")]


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> TableCatalog:
    return load_directory(spark, sf_dir, names or TEST_TABLES)


def _outer(spark: SparkSession, sf_dir: str) -> TableCatalog:
    """documents with their labels, if any: quality and toxic are null for most."""
    t = _tables(spark, sf_dir, "documents", "labels")
    joined = t.require("documents").select("doc_id", "lang", "source", "n_chars").join(t.require("labels"), "doc_id", "left")
    return TableCatalog({"documents_labels": joined})


def _partial(spark: SparkSession, sf_dir: str) -> TableCatalog:
    t = _tables(spark, sf_dir, "lineitem", "orders")
    t.register("orders_f", t.require("orders").where("o_orderstatus = 'F'"))
    return t


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_inventory(_tables(spark, sf_dir)).select("table_name", "n_rows", "n_cols")


def null_profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table."""
    return ops.null_profile(_tables(spark, sf_dir), all_columns=True).select("table_name", "column_name", "n_null", "n_rows", "pct_null")


def null_profile_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.null_profile(_outer(spark, sf_dir)).select("table_name", "column_name", "n_null", "n_rows", "pct_null")


def null_profile_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tables(spark, sf_dir, "lineitem").require("lineitem").withColumn("l_linenumber", F.expr("nullif(l_linenumber, 1)"))
    return ops.null_profile(TableCatalog({"lineitem": df})).select("table_name", "column_name", "n_null", "n_rows", "pct_null")


def null_profile_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN counts as missing: values of finished orders are made NaN."""
    df = _tables(spark, sf_dir, "orders").require("orders").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    return ops.null_profile(TableCatalog({"orders": df})).select("table_name", "column_name", "n_null", "n_rows", "pct_null")


def null_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.annotate_nulls(ops.null_profile(_outer(spark, sf_dir)), MEANINGS).select("table_name", "column_name", "n_null", "pct_null", "meaning")


_FK = ("rule_id", "from_column", "to_column", "refs", "orphans", "status")


def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fk_check(_tables(spark, sf_dir), FK_RULES).select(*_FK)


def fk_check_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fk_check_joins(_tables(spark, sf_dir), FK_RULES).select(*_FK)


def fk_check_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fk_check_long(_tables(spark, sf_dir), [*FK_RULES, LOOSE]).select(*_FK)


def fk_check_partial_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fk_check(_partial(spark, sf_dir), [PARTIAL]).select(*_FK)


def fk_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.orphan_keys(_partial(spark, sf_dir), PARTIAL).withColumnRenamed("key", "l_orderkey")


def fk_orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.orphan_rows(_partial(spark, sf_dir), PARTIAL).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))


def fk_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _partial(spark, sf_dir)
    return t.require("lineitem").select("l_orderkey").subtract(t.require("orders_f").select("o_orderkey"))


def fk_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole doubles meet integers, also from 10**15 on (keys of up to 9,000 are scaled, so that a long holds them); text keys meet neither."""
    t = _tables(spark, sf_dir, "orders", "customer")
    big = lambda c: F.col(c) % 9000 * F.lit(10**15).cast("long")
    o = t.require("orders").select(F.col("o_custkey").cast("double").alias("as_double"), F.col("o_custkey").cast("string").alias("as_text"), big("o_custkey").cast("double").alias("as_big"))
    t.register("orders_cast", o)
    t.register("customer_big", t.require("customer").where("c_custkey % 3 != 0").select(big("c_custkey").alias("c_big")))
    rules = parse_fk_rules("M01 orders_cast.as_double -> customer.c_custkey\nM02 orders_cast.as_text -> customer.c_custkey\nM03 orders_cast.as_big -> customer_big.c_big")
    return ops.fk_check(t, rules).select(*_FK)


def cardinality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cardinality_profile(_tables(spark, sf_dir), CARDINALITY_RULES).drop("ordinal")


def cardinality_childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents without children count as parents only: n_childless is how many there are."""
    t = _tables(spark, sf_dir, "orders", "lineitem")
    prof = ops.cardinality_profile(t, parse_cardinality_rules("E17 orders.o_orderkey 1:N lineitem.l_orderkey")).select("rule_id", "n_parents", "avg_children", "min_children", "max_children")
    less = ops.orphan_keys(t, FkRule("", "orders", "o_orderkey", "lineitem", "l_orderkey")).agg(F.count(F.lit(1)).alias("n_childless")).withColumn("rule_id", F.lit("E17"))
    return prof.join(less, "rule_id")


def cardinality_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parse_cardinality_rules("V01 customer.c_custkey 1:N orders.o_custkey\nV02 lineitem.l_orderkey 1:N orders.o_orderkey")
    return declared_violations(_tables(spark, sf_dir, "customer", "orders", "lineitem"), rules)


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.group_sizes(_tables(spark, sf_dir, "orders").require("orders"), "o_custkey").withColumnRenamed("key", "o_custkey")


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_keys(_tables(spark, sf_dir, "events").require("events"), "user_id").withColumnRenamed("key", "user_id")


def sheet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table sheets of a workbook that has a sheet for each nation, some of them named as summaries."""
    names = [(r.n_nationkey, r.n_name) for r in _tables(spark, sf_dir, "nation").require("nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    marks = {0: "Résumé ", 1: "📋 ", 2: "My RESUME "}
    path = write_workbook(spark, {marks.get(k % 5, "") + n: [["x"]] for k, n in names})
    return list_sheets(spark, path).select("sheet")


def _book(spark: SparkSession, sf_dir: str) -> TableCatalog:
    """nation and region, read back from a workbook with summaries and banners."""
    t = _tables(spark, sf_dir, "nation", "region")
    nation = t.require("nation").withColumn("n_name", F.when(F.col("n_nationkey") % 7 == 3, "N/A").otherwise(F.col("n_name")))
    sheets = {"📋 Overview": [["summary"]], "nation": sheet_rows(nation, "All nations"), "Résumé": [["summary"]], "region": sheet_rows(t.require("region").where("r_regionkey != 2"), "Some regions")}
    return load_workbooks(spark, {"TPC": write_workbook(spark, sheets)})


def workbook_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_inventory(_book(spark, sf_dir)).drop("ordinal")


def workbook_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.null_profile(_book(spark, sf_dir), all_columns=True).select("table_name", "column_name", "n_null", "n_rows", "pct_null")


def workbook_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fk_check(_book(spark, sf_dir), [FkRule("W01", "TPC/nation", "n_regionkey", "TPC/region", "r_regionkey")]).select(*_FK)


def fk_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose child lacks the column are left out, the rest stand."""
    rules = [FK_RULES[0], FkRule("X01", "nation", "no_such_column", "region", "r_regionkey"), FK_RULES[1]]
    return ops.fk_check(_tables(spark, sf_dir, "nation", "region", "customer"), rules).select(*_FK)


def cardinality_missing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with a table missing are left out, the rest stand."""
    return ops.cardinality_profile(_tables(spark, sf_dir, "region", "nation"), CARDINALITY_RULES[:3]).drop("ordinal")


def _enterprise() -> dict[str, str]:
    """A SELECT over all of orders for each table that the enterprise rules name: keys repeat, some are null, ranges differ so that there are orphans."""
    columns: dict[str, set[str]] = {}
    for r in ENTERPRISE_FK:
        columns.setdefault(r.child_table, set()).add(r.child_column)
        columns.setdefault(r.ref_table, set()).add(r.ref_column)
    for c in ENTERPRISE_CARDINALITY:
        columns.setdefault(c.parent_table, set()).add(c.parent_column)
        columns.setdefault(c.child_table, set()).add(c.child_column)
    out = {}
    for t, name in enumerate(sorted(columns)):
        each = [f"CASE WHEN o_orderkey % 11 <> {j} THEN (o_custkey * {j + 1} + {t}) % {50 + 7 * t} END AS {c}" for j, c in enumerate(sorted(columns[name]))]
        out[name] = f"SELECT {', '.join(each)} FROM {{orders}}"
    return out


def _enterprise_tables(spark: SparkSession, sf_dir: str) -> TableCatalog:
    orders = _tables(spark, sf_dir, "orders").require("orders").select("o_orderkey", "o_custkey")
    return TableCatalog({name: spark.sql(sql, orders=orders) for name, sql in _enterprise().items()})


def enterprise_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 rules of the enterprise systems on tables cut from orders."""
    return ops.fk_check_long(_enterprise_tables(spark, sf_dir), ENTERPRISE_FK).select(*_FK)


def enterprise_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 cardinality rules of the enterprise systems on the same tables."""
    return ops.cardinality_profile(_enterprise_tables(spark, sf_dir), ENTERPRISE_CARDINALITY).drop("ordinal")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "region", "nation", "customer")
    t.register("closed", t.require("customer").where("false"))
    rules = [*CARDINALITY_RULES[:2], CardinalityRule("R01", "nation", "n_nationkey", "closed", "c_nationkey")]
    return report(inventory_lines(ops.table_inventory(t)), null_lines(ops.null_profile(_outer(spark, sf_dir))), fk_lines(ops.fk_check(t, FK_RULES[:2])), cardinality_lines(ops.cardinality_profile(t, rules)))


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a text report: inventory, missing values, foreign keys and cardinalities, one of them of a table without rows."""
    return _report(spark, sf_dir).select("line")


def text_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written as text and read back."""
    path = f"{shared_dir(spark)}/rowkeel-report-{uuid.uuid4().hex}"
    write_report(_report(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign-key records written as JSON and read back."""
    found = ops.fk_check_long(_tables(spark, sf_dir), FK_RULES)
    path = f"{shared_dir(spark)}/rowkeel-results-{uuid.uuid4().hex}"
    write_results(found, path, "json")
    return spark.read.schema(found.schema).json(path).select(*_FK)


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, containment, concatenation and padding."""
    n = _tables(spark, sf_dir, "nation").require("nation")
    return n.select("n_nationkey", F.lower("n_name").alias("low"), F.col("n_name").contains("A").alias("has_a"), F.rpad("n_name", 45, " ").alias("padded"), F.lpad(F.col("n_nationkey").cast("string"), 5, " ").alias("right"))


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, "nation").require("nation").select(qualified_name("nation", F.col("n_name")).alias("qualified"))


def status_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    t.register("orders_f", t.require("orders").where("o_orderstatus = 'F'"))
    return ops.fk_check(t, [*FK_RULES, PARTIAL]).select("rule_id", (F.col("orphans") == 0).alias("ok"), status(F.col("orphans")).alias("status"))


def half_even_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of line numbers, rounded half to even."""
    li = _tables(spark, sf_dir, "lineitem").require("lineitem")
    by = li.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("part"))
    return by.select("l_linenumber", percent(F.col("part"), F.col("n")).alias("pct"))


def null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-frame null predicate: rows by how many of their values are missing."""
    df = _outer(spark, sf_dir).require("documents_labels")
    n = reduce(lambda a, b: a + b, [is_missing(df, c).cast("long") for c in df.columns])
    return df.select(n.alias("n_missing")).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows"))


_ALL: tuple[Query, ...] = (
    table_inventory,
    null_profile_full,
    null_profile_outer,
    null_profile_nullif,
    null_profile_nan,
    null_meaning,
    null_rows,
    fk_check,
    fk_check_joins,
    fk_check_long,
    fk_check_partial_ref,
    fk_orphan_keys,
    fk_orphan_rows,
    fk_except,
    fk_mixed_types,
    cardinality_profile,
    cardinality_childless,
    cardinality_declared,
    group_sizes,
    distinct_keys,
    sheet_filter,
    text_functions,
    qualified_names,
    status_flag,
    half_even_percent,
    workbook_inventory,
    workbook_nulls,
    workbook_fk,
    fk_missing_column,
    cardinality_missing_table,
    enterprise_fk,
    enterprise_cardinality,
    text_report,
    text_report_file,
    kept_results,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*_ALL, *extensions.ALL)}


_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
_WIDTHS = {t: len(c.split()) for t, c in _COLUMNS.items()}


def _null_sql(table: str, source: str, columns: str, missing: str = "{c} IS NULL", only: bool = True) -> str:
    each = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {missing.format(c=c)}) AS n_null, count(*) AS n_rows FROM {source}" for c in columns.split()]
    body = " UNION ALL ".join(each)
    return f"SELECT *, round_even(n_null / n_rows * 100, 1) AS pct_null FROM ({body})" + (" WHERE n_null > 0" if only else "")


def _fk_sql(r: FkRule, ref: str | None = None) -> str:
    return (
        f"SELECT '{r.rule_id}' AS rule_id, '{r.child_table}.{r.child_column}' AS from_column, '{r.ref_table}.{r.ref_column}' AS to_column, count(*) AS refs, "
        f"count(*) FILTER (WHERE p.k IS NULL) AS orphans FROM (SELECT DISTINCT {r.child_column} AS k FROM {r.child_table} WHERE {r.child_column} IS NOT NULL) c "
        f"LEFT JOIN (SELECT DISTINCT {r.ref_column} AS k FROM {ref or r.ref_table} WHERE {r.ref_column} IS NOT NULL) p ON c.k = p.k"
    )


def _with_status(*sql: str) -> str:
    return "SELECT *, CASE WHEN orphans = 0 THEN 'OK' ELSE orphans || ' orphans' END AS status FROM (" + " UNION ALL ".join(sql) + ")"


_ORDERS_F = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
_OUTER = "(SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_ORPHANS = "SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey)"


def _cardinality_sql(rules=CARDINALITY_RULES) -> str:
    each = [
        f"SELECT '{r.rule_id}' AS rule_id, '{r.parent_table}.{r.parent_column}' AS parent, '{r.declared}' AS declared, '{r.child_table}.{r.child_column}' AS child, "
        f"(SELECT count(DISTINCT {r.parent_column}) FROM {r.parent_table}) AS n_parents, avg(n) AS avg_children, min(n) AS min_children, max(n) AS max_children "
        f"FROM (SELECT count(*) AS n FROM {r.child_table} WHERE {r.child_column} IS NOT NULL GROUP BY {r.child_column})"
        for r in rules
    ]
    return " UNION ALL ".join(each)


def _enterprise_sql(body: str, *labels: str) -> str:
    """body over the enterprise tables, in whose names __ stands for the slash; labels are the columns that show the names."""
    tables = ", ".join(f"{n.replace('/', '__')} AS ({sql.format(orders='orders')})" for n, sql in _enterprise().items())
    return f"WITH {tables} SELECT * REPLACE ({', '.join(f"replace({c}, '__', '/') AS {c}" for c in labels)}) FROM ({body})"


def _report_sql(nulls: str) -> str:
    tables = ("region", "nation", "customer")
    cards = [*CARDINALITY_RULES[:2], CardinalityRule("R01", "nation", "n_nationkey", "closed", "c_nationkey")]
    stock = [f"SELECT format('{{:<45}} {{:>5}} rows {{:>2}} columns', '{n}', count(*), {_WIDTHS[w]}) AS line FROM {n}" for n, w in [*((t, t) for t in tables), ("closed", "customer")]]
    number = lambda c, f: f"CASE WHEN {c} IS NULL THEN 'nan' ELSE {f} END"
    mean, low, high = number("avg_children", "printf('%.1f', avg_children)"), number("min_children", "min_children::VARCHAR"), number("max_children", "max_children::VARCHAR")
    sizes = f"SELECT parent || ' ' || declared || ' ' || child || ': ' || n_parents || ' parents, children avg ' || {mean} || ', min ' || {low} || ', max ' || {high} FROM ({_cardinality_sql(cards)})"
    missing = f"SELECT table_name || '.' || column_name || ': ' || n_null || ' null (' || pct_null || ' %)' FROM ({nulls})"
    keys = f"SELECT from_column || ' -> ' || to_column || ': ' || refs || ' refs, ' || status FROM ({_with_status(*map(_fk_sql, FK_RULES[:2]))})"
    return "WITH closed AS (SELECT * FROM customer WHERE false) " + " UNION ALL ".join([*stock, missing, keys, sizes])


def oracle_sql() -> dict[str, str]:
    outer_nulls = _null_sql("documents_labels", _OUTER, "doc_id lang source n_chars quality toxic")
    mixed = [FkRule("M01", "orders_cast", "as_double", "customer", "c_custkey"), FkRule("M02", "orders_cast", "as_text", "customer", "c_custkey"), FkRule("M03", "orders_cast", "as_big", "customer_big", "c_big")]
    casts = (
        "WITH orders_cast AS (SELECT o_custkey::DOUBLE AS as_double, 's:' || o_custkey AS as_text, (o_custkey % 9000 * 1000000000000000)::BIGINT AS as_big FROM orders), "
        "customer_big AS (SELECT c_custkey % 9000 * 1000000000000000 AS c_big FROM customer WHERE c_custkey % 3 <> 0) "
    )
    book = FkRule("W01", "nation", "n_regionkey", "region", "r_regionkey")
    nations = "(SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 3 THEN n_name END AS n_name, n_regionkey FROM nation)"
    return {
        "table_inventory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {_WIDTHS[t]}::BIGINT AS n_cols FROM {t}" for t in TEST_TABLES),
        "null_profile_full": " UNION ALL ".join(_null_sql(t, t, _COLUMNS[t], only=False) for t in TEST_TABLES),
        "null_profile_outer": outer_nulls,
        "null_profile_nullif": _null_sql("lineitem", "(SELECT * REPLACE (nullif(l_linenumber, 1) AS l_linenumber) FROM lineitem)", _COLUMNS["lineitem"]),
        "null_profile_nan": "SELECT 'orders' AS table_name, 'o_totalprice' AS column_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_null, count(*) AS n_rows, round_even(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 100, 1) AS pct_null FROM orders",
        "null_meaning": f"SELECT table_name, column_name, n_null, pct_null, CASE column_name WHEN 'quality' THEN 'not rated' WHEN 'toxic' THEN 'not screened' END AS meaning FROM ({outer_nulls})",
        "null_rows": f"SELECT ((quality IS NULL)::INT + (toxic IS NULL)::INT + (doc_id IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (n_chars IS NULL)::INT)::BIGINT AS n_missing, count(*) AS n_rows FROM {_OUTER} GROUP BY 1",
        "fk_check": _with_status(*map(_fk_sql, FK_RULES)),
        "fk_check_joins": _with_status(*map(_fk_sql, FK_RULES)),
        "fk_check_long": _with_status(*map(_fk_sql, [*FK_RULES, LOOSE])),
        "fk_check_partial_ref": _with_status(_fk_sql(PARTIAL, _ORDERS_F)),
        "fk_orphan_keys": _ORPHANS,
        "fk_orphan_rows": f"SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN ({_ORPHANS}) GROUP BY 1",
        "fk_except": "SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F'",
        "fk_mixed_types": casts + _with_status(_fk_sql(mixed[0]), _fk_sql(mixed[1], "(SELECT 'n:' || c_custkey AS c_custkey FROM customer)"), _fk_sql(mixed[2])),
        "cardinality_profile": _cardinality_sql(),
        "cardinality_childless": "SELECT 'E17' AS rule_id, (SELECT count(*) FROM orders) AS n_parents, avg(n) AS avg_children, min(n) AS min_children, max(n) AS max_children, "
        "(SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n_childless FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
        "cardinality_declared": "SELECT 'V01' AS rule_id, count(*) FILTER (WHERE n > 1) AS repeated_parents FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey) "
        "UNION ALL SELECT 'V02' AS rule_id, count(*) FILTER (WHERE n > 1) AS repeated_parents FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
        "group_sizes": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1",
        "distinct_keys": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
        "sheet_filter": "SELECT n_name AS sheet FROM nation WHERE n_nationkey % 5 >= 3",
        "workbook_inventory": "SELECT 'TPC/nation' AS table_name, count(*) AS n_rows, 3::BIGINT AS n_cols FROM nation UNION ALL SELECT 'TPC/region', count(*), 2 FROM region WHERE r_regionkey <> 2",
        "workbook_nulls": _null_sql("TPC/nation", nations, _COLUMNS["nation"], only=False) + " UNION ALL " + _null_sql("TPC/region", "(SELECT * FROM region WHERE r_regionkey <> 2)", _COLUMNS["region"], only=False),
        "workbook_fk": _with_status(_fk_sql(book, "(SELECT * FROM region WHERE r_regionkey <> 2)").replace("'nation.", "'TPC/nation.").replace("'region.", "'TPC/region.")),
        "fk_missing_column": _with_status(*map(_fk_sql, FK_RULES[:2])),
        "cardinality_missing_table": _cardinality_sql(CARDINALITY_RULES[:1]),
        "text_functions": "SELECT n_nationkey, lower(n_name) AS low, contains(n_name, 'A') AS has_a, rpad(n_name, 45, ' ') AS padded, lpad(n_nationkey::VARCHAR, 5, ' ') AS \"right\" FROM nation",
        "qualified_names": "SELECT 'nation.' || n_name AS qualified FROM nation",
        "status_flag": "SELECT rule_id, orphans = 0 AS ok, status FROM (" + _with_status(*map(_fk_sql, FK_RULES), _fk_sql(PARTIAL, _ORDERS_F)) + ")",
        "half_even_percent": "SELECT l_linenumber, round_even(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) AS pct FROM lineitem GROUP BY 1",
        "enterprise_fk": _enterprise_sql(_with_status(*[_fk_sql(FkRule(r.rule_id, r.child_table.replace("/", "__"), r.child_column, r.ref_table.replace("/", "__"), r.ref_column)) for r in ENTERPRISE_FK]), "from_column", "to_column"),
        "enterprise_cardinality": _enterprise_sql(_cardinality_sql([CardinalityRule(c.rule_id, c.parent_table.replace("/", "__"), c.parent_column, c.child_table.replace("/", "__"), c.child_column, c.declared) for c in ENTERPRISE_CARDINALITY]), "parent", "child"),
        "text_report": _report_sql(outer_nulls),
        "text_report_file": _report_sql(outer_nulls),
        "kept_results": _with_status(*map(_fk_sql, FK_RULES)),
    } | extensions.SQL
