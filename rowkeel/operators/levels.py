"""Missing values and orphan rows at several levels at once. An extension of the audits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TableCatalog
from ..functions.keys import canonical_key
from ..functions.missing import is_missing
from ..functions.scalars import percent
from ..rules import FkRule
from .foreign_keys import distinct_keys


def level_profile(catalog: TableCatalog, by: Mapping[str, str], rules: Iterable[FkRule] = ()) -> DataFrame:
    """level (source, table, all), table_name, source, n_rows, n_values, n_null, pct_null, n_refs, n_orphans, pct_orphans.

    by: for each table the column that tells where its rows come from, a null or NaN there is a source of its own (level tells it from a total,
    whose source is null as well). n_values and n_null count all values of all columns; n_refs and n_orphans those rows' keys, by all rules of the table, that are there, and
    that the referenced column lacks. Rates of nothing are null. A missing table or column raises KeyError. An empty table has no rows, and nothing at all gives one row, for all.

    Each table is scanned once and meets the distinct keys of each rule's reference; grouping sets then make all levels from one shuffle of sums that tasks form first.
    """
    rules = list(rules)
    parts = []
    for table, column in by.items():
        df = catalog.require_column(table, column)
        null = reduce(lambda a, b: a + b, [is_missing(df, c).cast("long") for c in df.columns])
        own = [r for r in rules if r.child_table == table]
        keys = [F.when(~is_missing(catalog.require_column(table, r.child_column), r.child_column), canonical_key(df[f"`{r.child_column}`"], df.schema[r.child_column].dataType)).alias(f"_k{i}") for i, r in enumerate(own)]
        rows = df.select(F.lit(table).alias("table_name"), F.when(~is_missing(df, column), df[f"`{column}`"]).cast("string").alias("source"), F.lit(len(df.columns)).cast("long").alias("n_values"), null.alias("n_null"), *keys)
        for i, r in enumerate(own):
            found = distinct_keys(catalog.require_column(r.ref_table, r.ref_column), r.ref_column, plain=False).select(F.col("key").alias(f"_k{i}"), F.lit(True).alias(f"_f{i}"))
            rows = rows.join(found, f"_k{i}", "left")
        count = lambda each: reduce(lambda a, b: a + b, [c.cast("long") for c in each], F.lit(0).cast("long"))
        refs = count([F.col(f"_k{i}").isNotNull() for i in range(len(own))])
        orphans = count([F.col(f"_k{i}").isNotNull() & F.col(f"_f{i}").isNull() for i in range(len(own))])
        parts.append(rows.select("table_name", "source", "n_values", "n_null", refs.alias("n_refs"), orphans.alias("n_orphans")))
    if not parts:
        raise ValueError("there are no tables")
    whole = reduce(DataFrame.unionByName, parts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_values", "n_null", "n_refs", "n_orphans")]
    levels = whole.groupingSets([["table_name", "source"], ["table_name"], []], "table_name", "source").agg(F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n_rows"), *sums)
    level = F.when(F.col("_level") == 0, "source").when(F.col("_level") == 1, "table").otherwise("all")
    return levels.select(level.alias("level"), "table_name", "source", "n_rows", "n_values", "n_null", percent(F.col("n_null"), F.col("n_values")).alias("pct_null"), "n_refs", "n_orphans", percent(F.col("n_orphans"), F.col("n_refs")).alias("pct_orphans"))
