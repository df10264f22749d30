"""Missing values by column, and what they mean."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TableCatalog, short_name
from ..functions.missing import is_missing
from ..functions.scalars import percent
from ..rules import NullMeaning


def _profile(name: str, df: DataFrame, ordinal: int) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    # One pass over the table; the single row of counts is then turned into a row for each column.
    each = F.array(*[F.struct(F.lit(i).alias("column_ordinal"), F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return (
        counted.select("n", F.explode(each).alias("c"))
        .select(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("table_name"), "c.*", F.col("n").alias("n_rows"))
        .withColumn("pct_null", percent(F.col("n_null"), F.col("n_rows")))
    )


def null_profile(catalog: TableCatalog, *, all_columns: bool = False) -> DataFrame:
    """ordinal, table_name, column_ordinal, column_name, n_null, n_rows, pct_null for columns with missing values.

    all_columns: also those without any; pct_null of an empty table is then null.
    """
    parts = [_profile(name, df, i) for i, (name, df) in enumerate(catalog.items()) if df.columns]
    if not parts:
        raise ValueError("the catalog has no columns")
    out = reduce(DataFrame.unionByName, parts)
    return out if all_columns else out.where("n_null > 0")


def annotate_nulls(profile: DataFrame, meanings: Iterable[NullMeaning]) -> DataFrame:
    """profile with a column meaning: that of table.column if there is one, else that of *.column, else null.

    Tables are known by the part after the system. Of two meanings of one pattern the later holds.
    """
    spark = profile.sparkSession
    latest = {m.pattern: m for m in meanings}
    rows = [(m.table, m.column, m.meaning) for m in latest.values()]
    said = spark.createDataFrame(rows, "t string, c string, meaning string")
    short = F.element_at(F.split("table_name", "/"), -1)
    exact = said.where("t != '*'").select("t", "c", F.col("meaning").alias("_exact"))
    any_ = said.where("t = '*'").select(F.col("c").alias("c2"), F.col("meaning").alias("_any"))
    # The dictionary is the caller's list of rules: its size doesn't follow the data.
    out = profile.join(F.broadcast(exact), (short == F.col("t")) & (F.col("column_name") == F.col("c")), "left")
    out = out.join(F.broadcast(any_), F.col("column_name") == F.col("c2"), "left")
    return out.select(*profile.columns, F.coalesce("_exact", "_any").alias("meaning"))


def meaning_of(table: str, column: str, meanings: Iterable[NullMeaning]) -> str | None:
    """The same for one column, on the driver."""
    latest = {m.pattern: m.meaning for m in meanings}
    return latest.get(f"{short_name(table)}.{column}", latest.get(f"*.{column}"))
