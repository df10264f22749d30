"""Rows and columns of every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TableCatalog


def table_inventory(catalog: TableCatalog) -> DataFrame:
    """ordinal, table_name, n_rows, n_cols in order of registration. Rows whose values are all null count.

    One grouping counts all tables, partly in each task; the list of tables, which the catalog bounds, keeps empty ones.
    """
    if not len(catalog):
        raise ValueError("the catalog is empty")
    named = list(enumerate(catalog.items()))
    marks = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("ordinal")) for i, (_, df) in named])
    counted = marks.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    own = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("long").alias("n_cols")) for i, (name, df) in named])
    listed = marks.sparkSession.range(1, numPartitions=1).select(F.inline(own))
    found = counted.join(F.broadcast(listed), "ordinal", "right")
    return found.select("ordinal", "table_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), "n_cols")
