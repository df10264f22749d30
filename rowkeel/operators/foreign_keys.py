"""Foreign-key checks: distinct child keys without a match among the referenced keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TableCatalog
from ..functions.keys import canonical_key, comparable
from ..functions.missing import is_present
from ..functions.scalars import qualified_name, status
from ..rules import FkRule


def _columns(catalog: TableCatalog, rule: FkRule) -> tuple[DataFrame, DataFrame] | None:
    """Child and referenced table; None if the child lacks the column. Missing tables and referenced columns raise KeyError."""
    ref = catalog.require_column(rule.ref_table, rule.ref_column)
    child = catalog.require(rule.child_table)
    return (child, ref) if rule.child_column in child.columns else None


def _key(df: DataFrame, column: str, plain: bool) -> Column:
    c = df[f"`{column}`"]
    return c if plain else canonical_key(c, df.schema[column].dataType)


def distinct_keys(df: DataFrame, column: str, *, plain: bool = True) -> DataFrame:
    """key: the distinct values that are neither null nor NaN. plain: as they are, else in canonical form."""
    return df.where(is_present(df, column)).select(_key(df, column, plain).alias("key")).distinct()


def _sides(catalog: TableCatalog, rule: FkRule) -> tuple[DataFrame, DataFrame] | None:
    found = _columns(catalog, rule)
    if not found:
        return None
    child, ref = found
    plain = comparable(child.schema[rule.child_column].dataType, ref.schema[rule.ref_column].dataType)
    return distinct_keys(child, rule.child_column, plain=plain), distinct_keys(ref, rule.ref_column, plain=plain)


def orphan_keys(catalog: TableCatalog, rule: FkRule) -> DataFrame:
    """key: the distinct child keys that the referenced column lacks. Keys of different types are shown in canonical form."""
    sides = _sides(catalog, rule)
    if not sides:
        raise KeyError(f"table {rule.child_table!r} has no column {rule.child_column!r}")
    child, ref = sides
    return child.join(ref, "key", "left_anti")


def orphan_rows(catalog: TableCatalog, rule: FkRule) -> DataFrame:
    """The child's rows (all columns) whose key is an orphan. An extension of the audit, which counts distinct keys."""
    child = catalog.require_column(rule.child_table, rule.child_column)
    ref = catalog.require_column(rule.ref_table, rule.ref_column)
    plain = comparable(child.schema[rule.child_column].dataType, ref.schema[rule.ref_column].dataType)
    keys = distinct_keys(ref, rule.ref_column, plain=plain).withColumnRenamed("key", "_ref_key")
    return child.where(is_present(child, rule.child_column)).join(keys, _key(child, rule.child_column, plain) == F.col("_ref_key"), "left_anti")


def _record(rule: FkRule, i: int) -> list[Column]:
    return [
        F.lit(i).alias("ordinal"),
        F.lit(rule.rule_id).alias("rule_id"),
        qualified_name(rule.child_table, rule.child_column).alias("from_column"),
        qualified_name(rule.ref_table, rule.ref_column).alias("to_column"),
    ]


def _none(rules: list[FkRule]) -> ValueError:
    return ValueError("no rule applies" if rules else "there are no rules")


#: From so many rules on, one grouping for all is cheaper than a join and an aggregate for each.
_MANY = 5


def fk_check(catalog: TableCatalog, rules: Iterable[FkRule]) -> DataFrame:
    """ordinal, rule_id, from_column, to_column, refs, orphans, status: a row for each rule.

    refs and orphans are numbers of distinct child keys; null and NaN are no keys, so a column without
    any gives 0, 0 and OK. Rules whose child lacks the column are left out (see skipped_rules). Few rules are a join each
    (fk_check_joins), five and more one job (fk_check_long); the records are the same.
    """
    rules = list(rules)
    return (fk_check_long if len(rules) >= _MANY else fk_check_joins)(catalog, rules)


def fk_check_joins(catalog: TableCatalog, rules: Iterable[FkRule]) -> DataFrame:
    """The records of fk_check from one join a rule: each child is scanned once, distinct keys left join distinct referenced keys."""
    rules, parts = list(rules), []
    for i, rule in enumerate(rules):
        sides = _sides(catalog, rule)
        if not sides:
            continue
        child, ref = sides
        matched = child.join(ref.withColumn("found", F.lit(True)), "key", "left")
        counts = matched.agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("found").isNull()).alias("orphans"))
        parts.append(counts.select(*_record(rule, i), "refs", "orphans", status(F.col("orphans")).alias("status")))
    if not parts:
        raise _none(rules)
    return reduce(DataFrame.unionByName, parts)


#: Rules that share a job of fk_check_long: a bit each of a long, the highest one marks a referenced key.
_RULES_A_JOB, _FOUND = 62, 1 << 62


def fk_check_long(catalog: TableCatalog, rules: Iterable[FkRule]) -> DataFrame:
    """The same records from one job for up to 62 rules: (target, key) of all children and references, grouped once.

    Each row carries a bit for its rule, or for being a reference, and the bits of a key are or-ed, on
    the way to the one shuffle already. A referenced column is read once however many rules point to it.
    """
    rules = list(rules)
    live = [(i, r) for i, r in enumerate(rules) if _columns(catalog, r)]
    if not live:
        raise _none(rules)
    return reduce(DataFrame.unionByName, [_long_job(catalog, live[k : k + _RULES_A_JOB]) for k in range(0, len(live), _RULES_A_JOB)])


def _long_job(catalog: TableCatalog, live: list[tuple[int, FkRule]]) -> DataFrame:
    sides: dict[tuple[str, str], list[tuple[str, str, int]]] = {}
    for bit, (_, r) in enumerate(live):
        sides.setdefault((r.ref_table, r.ref_column), [(r.ref_table, r.ref_column, _FOUND)]).append((r.child_table, r.child_column, 1 << bit))
    parts = []
    for target, columns in enumerate(sides.values()):
        kinds = [catalog.require(t).schema[c].dataType for t, c, _ in columns]
        plain = all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds)
        for t, c, bit in columns:
            df = catalog.require(t)
            key = _key(df, c, plain)
            # Whole numbers stay numbers; all else is canonical text.
            number, text = (key.cast("long"), F.lit(None).cast("string")) if plain else (F.lit(None).cast("long"), key)
            parts.append(df.where(is_present(df, c)).select(F.lit(target).alias("target"), number.alias("number"), text.alias("text"), F.lit(bit).cast("long").alias("bit")))
    met = reduce(DataFrame.unionByName, parts).groupBy("target", "number", "text").agg(F.bit_or("bit").alias("bits"))
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0
    counts = met.agg(*[x for n in range(len(live)) for x in (F.count_if(has(1 << n)).alias(f"refs{n}"), F.count_if(has(1 << n) & ~has(_FOUND)).alias(f"orphans{n}"))])
    # The one row of counts has those of rules without any key too.
    rows = F.array(*[F.struct(*_record(r, i), F.col(f"refs{n}").alias("refs"), F.col(f"orphans{n}").alias("orphans")) for n, (i, r) in enumerate(live)])
    return counts.select(F.explode(rows).alias("r")).select("r.*", status(F.col("r.orphans")).alias("status"))


def skipped_rules(catalog: TableCatalog, rules: Iterable[FkRule]) -> list[FkRule]:
    """Rules that fk_check leaves out because the child table has no such column."""
    return [r for r in rules if _columns(catalog, r) is None]
