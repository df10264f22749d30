"""What depends on given rows, along the foreign-key rules. An extension of the audits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import TableCatalog
from ..functions.keys import canonical_key, comparable
from ..functions.missing import is_present
from ..rules import FkRule
from ..shared import saved

_DEPTH = "depth"


def cascade(catalog: TableCatalog, rules: Iterable[FkRule], roots: Mapping[str, Column], *, depth: str = _DEPTH) -> dict[str, DataFrame]:
    """For each table that rules or roots name and something reaches: its dependent rows with their depth.

    roots: a condition for each table whose rows to start from; they have depth 0. A row depends on any row that one of its foreign keys
    points to, and its depth is the least number of steps to a root. Rows whose key is null or NaN, or points nowhere, depend on nothing by that rule. Rules
    whose child lacks the column are left out; a missing table or referenced column raises KeyError. Repeated rows are told each time; a column
    named as `depth` is replaced.

    Tables are taken in topological order: a table joins the reached keys of its parents once, each key with its least depth, so that
    keys, not rows, are shuffled against it. Where rules form a cycle, a self-reference included, the keys of its tables are closed
    semi-naively first: each round follows only keys that are new or nearer, and writes them to the shared folder.
    """
    rules = [r for r in rules if r.child_column in catalog.require(r.child_table).columns and catalog.require_column(r.ref_table, r.ref_column) is not None]
    for t in roots:
        catalog.require(t)
    out: dict[str, DataFrame] = {}
    for group in _groups([*dict.fromkeys([*roots, *(t for r in rules for t in (r.ref_table, r.child_table))])], rules):
        inner = [r for r in rules if r.child_table in group and r.ref_table in group]
        found = {t: _reached(catalog, t, [r for r in rules if r.child_table == t and r.ref_table in out], out, roots.get(t)) for t in group}
        if not inner:
            out |= {t: df for t, df in found.items() if df is not None}
            continue
        keys = _closed(catalog, inner, {t: df for t, df in found.items() if df is not None})
        for t in group:
            own = [r for r in rules if r.child_table == t and (r.ref_table in out or r in inner)]
            df = _reached(catalog, t, own, out, roots.get(t), keys)
            if df is not None:
                found[t] = df
        out |= {t: df for t, df in found.items() if df is not None}
    return {t: df.select(*[F.col(f"_row.`{c}`").alias(c) for c in catalog.require(t).columns if c != depth], F.col("_depth").alias(depth)) for t, df in out.items()}


def cascade_counts(catalog: TableCatalog, rules: Iterable[FkRule], roots: Mapping[str, Column]) -> DataFrame:
    """table_name, depth, n_rows: how many rows of each table depend on the roots, by depth; tables and depths without any are left out."""
    found = cascade(catalog, rules, roots)
    if not found:
        raise ValueError("there are no roots")
    return reduce(DataFrame.unionByName, [df.groupBy(_DEPTH).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), _DEPTH, "n_rows") for t, df in found.items()])


def _groups(tables: list[str], rules: list[FkRule]) -> list[list[str]]:
    """Tables in the order parents first, those of one cycle together."""
    below: dict[str, set[str]] = {t: {t} for t in tables}
    for _ in tables:  # rules are few: what each table reaches, by as many rounds as there are tables
        for r in rules:
            below[r.ref_table] |= below[r.child_table]
    groups = {frozenset(u for u in tables if u in below[t] and t in below[u]): None for t in tables}
    return [[t for t in tables if t in g] for g in sorted(groups, key=lambda g: -max(len(below[t]) for t in g))]


def _reached(catalog: TableCatalog, table: str, rules: list[FkRule], out: Mapping[str, DataFrame], root: Column | None, closed: DataFrame | None = None) -> DataFrame | None:
    """_row, _depth: the table's rows that a root or a rule reaches; None if nothing can."""
    if not rules and root is None:
        return None
    df = catalog.require(table)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.when(root, F.lit(0)).alias("_d") if root is not None else F.lit(None).cast("int").alias("_d"), *[_key(df, r.child_column, _plain(catalog, r, closed)).alias(f"_k{i}") for i, r in enumerate(rules)])
    for i, r in enumerate(rules):
        if closed is not None and r.ref_table not in out:
            keys = closed.where(F.col("column") == f"{r.ref_table}.{r.ref_column}").select(F.col("key").alias(f"_k{i}"), F.col("far").alias(f"_d{i}"))
        else:
            parent = out[r.ref_table].select("_row.*", "_depth")
            keys = parent.where(is_present(parent, r.ref_column)).groupBy(_key(parent, r.ref_column, _plain(catalog, r, closed)).alias(f"_k{i}")).agg(F.min("_depth").alias(f"_d{i}"))
        rows = rows.join(keys, f"_k{i}", "left")
    steps = [F.col("_d"), *[F.col(f"_d{i}") + 1 for i in range(len(rules))]]
    return rows.select("_row", (F.least(*steps) if len(steps) > 1 else steps[0]).alias("_depth")).where("_depth IS NOT NULL")


def _plain(catalog: TableCatalog, r: FkRule, closed: DataFrame | None) -> bool:
    kinds = (catalog.require(r.child_table).schema[r.child_column].dataType, catalog.require(r.ref_table).schema[r.ref_column].dataType)
    return closed is None and comparable(*kinds)


def _key(df: DataFrame, column: str, plain: bool) -> Column:
    c = df[f"`{column}`"]
    return F.when(is_present(df, column), c if plain else canonical_key(c, df.schema[column].dataType))


def _closed(catalog: TableCatalog, inner: list[FkRule], start: Mapping[str, DataFrame]) -> DataFrame:
    """column, key, far: the least depth of each key of the columns that the inner rules refer to."""
    columns = list(dict.fromkeys((r.ref_table, r.ref_column) for r in inner))
    name = lambda t, c: F.lit(f"{t}.{c}").alias("column")

    def told(rows: DataFrame, t: str, c: str) -> DataFrame:
        own = rows.select("_row.*", "_depth")
        return own.where(is_present(own, c)).select(name(t, c), _key(own, c, False).alias("key"), F.col("_depth").alias("far"))

    def least(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy("column", "key").agg(F.min("far").alias("far"))

    first = [told(start[t], t, c) for t, c in columns if t in start]
    if not first:
        t, c = columns[0]
        df = catalog.require(t)
        first = [df.where("false").select(name(t, c), _key(df, c, False).alias("key"), F.lit(0).alias("far"))]
    # A step: from a key of a referenced column to the keys of the child's own referenced columns.
    edges = []
    for r in inner:
        df = catalog.require(r.child_table)
        for t, c in columns:
            if t == r.child_table:
                edge = df.where(is_present(df, r.child_column) & is_present(df, c))
                edges.append(edge.select(F.lit(f"{r.ref_table}.{r.ref_column}").alias("column"), _key(edge, r.child_column, False).alias("key"), F.lit(f"{t}.{c}").alias("to_column"), _key(edge, c, False).alias("to_key")))
    delta = saved(least(first))
    found = [delta]
    if not edges:
        return delta
    steps = saved(reduce(DataFrame.unionByName, edges).distinct())
    while True:
        near = steps.join(delta, ["column", "key"]).select(F.col("to_column").alias("column"), F.col("to_key").alias("key"), (F.col("far") + 1).alias("far"))
        old = least(found).withColumnRenamed("far", "old")
        delta = saved(least([near]).join(old, ["column", "key"], "left").where("old IS NULL OR far < old").drop("old"))
        if delta.isEmpty():
            return least(found)
        # Each round writes what is new only; the rounds are put together now and then, so that plans stay short.
        found = [*found, delta] if len(found) < 8 else [saved(least([*found, delta]))]
