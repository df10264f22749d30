"""Audit results as text: lines of a report as a DataFrame, written by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalars import one_decimal


def _lines(df: DataFrame, line: Column, place: Column | None = None) -> DataFrame:
    return df.select(F.col("ordinal").cast("long").alias("ordinal"), (F.lit(0) if place is None else place).cast("long").alias("place"), line.alias("line"))


def inventory_lines(df: DataFrame) -> DataFrame:
    """ordinal, place, line of table_inventory()."""
    return _lines(df, F.format_string("%-45s %5d rows %2d columns", "table_name", "n_rows", "n_cols"))


def null_lines(df: DataFrame) -> DataFrame:
    """ordinal, place, line of null_profile()."""
    return _lines(df, F.format_string("%s.%s: %d null (%s %%)", "table_name", "column_name", "n_null", one_decimal(F.col("pct_null"))), F.col("column_ordinal"))


def fk_lines(df: DataFrame) -> DataFrame:
    """ordinal, place, line of fk_check()."""
    return _lines(df, F.format_string("%s -> %s: %d refs, %s", "from_column", "to_column", "refs", "status"))


def cardinality_lines(df: DataFrame) -> DataFrame:
    """ordinal, place, line of cardinality_profile(); nan where there are no children."""
    low, high = (F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("min_children", "max_children"))
    return _lines(df, F.format_string("%s %s %s: %d parents, children avg %s, min %s, max %s", "parent", "declared", "child", "n_parents", one_decimal(F.col("avg_children")), low, high))


def report(*sections: DataFrame) -> DataFrame:
    """section, ordinal, place, line: the sections' lines under their numbers from 0."""
    return reduce(DataFrame.unionByName, [s.select(F.lit(i).alias("section"), "ordinal", "place", "line") for i, s in enumerate(sections)])


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of report() as text files whose names keep their order; what is there is replaced. A report has a line a rule, table or column: Spark sorts it."""
    lines.orderBy("section", "ordinal", "place").select("line").write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Keep an audit's records as JSON lines, Parquet or any format that Spark writes; what is there is replaced."""
    df.write.mode("overwrite").format(fmt).save(path)
