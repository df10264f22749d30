"""How many children the keys of a parent have."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TableCatalog
from ..functions.keys import canonical_key
from ..functions.missing import is_present
from ..functions.scalars import qualified_name
from ..rules import CardinalityRule


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """key, n: rows by each key that is neither null nor NaN."""
    return df.where(is_present(df, column)).groupBy(df[f"`{column}`"].alias("key")).agg(F.count(F.lit(1)).alias("n"))


def cardinality_profile(catalog: TableCatalog, rules: Iterable[CardinalityRule]) -> DataFrame:
    """ordinal, rule_id, parent, declared, child, n_parents, avg_children, min_children, max_children: a row for each rule.

    n_parents counts distinct parent keys; the rest is over child keys only: parents without children
    don't count, children without a parent do. Without any child key the three are null. Rules with a
    table missing are left out; a missing column raises KeyError. A column is read once however many rules name it, and
    all keys meet in one grouping, partly in each task.
    """
    rules = list(rules)
    live = [(i, r) for i, r in enumerate(rules) if r.parent_table in catalog and r.child_table in catalog]
    if not live:
        raise ValueError("no rule applies" if rules else "there are no rules")
    sides: dict[tuple[str, str], int] = {}
    for _, r in live:
        for column in ((r.parent_table, r.parent_column), (r.child_table, r.child_column)):
            sides.setdefault(column, len(sides))
    sizes = reduce(DataFrame.unionByName, [_keys(catalog, t, c, n) for (t, c), n in sides.items()]).groupBy("side", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.groupBy("side").agg(F.count(F.lit(1)).alias("keys"), F.avg("n").alias("avg"), F.min("n").alias("min"), F.max("n").alias("max"))
    # One row for each side, which the rules bound, becomes one map; the rules look their sides up in it.
    held = stats.agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("keys", "avg", "min", "max")))).alias("of"))
    rows = F.array(*[_record(r, i, sides) for i, r in live])
    return held.select(F.inline(rows))


def _keys(catalog: TableCatalog, table: str, column: str, side: int) -> DataFrame:
    """side, and the keys of a column as number or text, whichever they are."""
    df = catalog.require_column(table, column)
    kind, c = df.schema[column].dataType, df[f"`{column}`"]
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number, text = (c.cast("long"), F.lit(None).cast("string")) if whole else (F.lit(None).cast("long"), _text(c, kind))
    return df.where(is_present(df, column)).select(F.lit(side).alias("side"), number.alias("number"), text.alias("text"))


def _text(c: Column, kind: T.DataType) -> Column:
    try:
        return canonical_key(c, kind)
    except TypeError:  # binary, arrays and the like
        return F.to_json(F.struct(c.alias("k")))


def _record(r: CardinalityRule, i: int, sides: dict[tuple[str, str], int]) -> Column:
    up, down = (F.try_element_at("of", F.lit(sides[x])) for x in ((r.parent_table, r.parent_column), (r.child_table, r.child_column)))
    return F.struct(
        F.lit(i).alias("ordinal"),
        F.lit(r.rule_id).alias("rule_id"),
        qualified_name(r.parent_table, r.parent_column).alias("parent"),
        F.lit(r.declared).alias("declared"),
        qualified_name(r.child_table, r.child_column).alias("child"),
        F.coalesce(up["keys"], F.lit(0).cast("long")).alias("n_parents"),
        down["avg"].alias("avg_children"),
        down["min"].alias("min_children"),
        down["max"].alias("max_children"),
    )


def declared_violations(catalog: TableCatalog, rules: Iterable[CardinalityRule]) -> DataFrame:
    """rule_id, repeated_parents: parent keys that occur more than once, which a declared 1 side forbids. An extension."""
    parts = []
    for r in rules:
        if r.parent_table in catalog and r.declared.startswith("1"):
            sizes = group_sizes(catalog.require_column(r.parent_table, r.parent_column), r.parent_column)
            parts.append(sizes.agg(F.count_if(F.col("n") > 1).alias("repeated_parents")).select(F.lit(r.rule_id).alias("rule_id"), "repeated_parents"))
    if not parts:
        raise ValueError("no rule applies")
    return reduce(DataFrame.unionByName, parts)
