"""A folder with one Parquet file or folder for each table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..catalog import TableCatalog

TEST_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load_directory(spark: SparkSession, path: str, tables: Iterable[str] = TEST_TABLES, *, system: str | None = None, view: bool = False) -> TableCatalog:
    """Register path/<table>.parquet under its name, or system/name. Nothing but the schemas is read."""
    catalog = TableCatalog()
    for t in tables:
        catalog.register(f"{system}/{t}" if system else t, spark.read.parquet(f"{path}/{t}.parquet"), view=view)
    return catalog
