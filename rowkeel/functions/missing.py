"""One notion of missing: null, and NaN in float columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def is_missing(df: DataFrame, column: str) -> Column:
    """Whether a value is null or NaN; never null itself."""
    c = df[f"`{column}`"]
    return (c.isNull() | F.isnan(c)) if isinstance(df.schema[column].dataType, _FLOATS) else c.isNull()


def is_present(df: DataFrame, column: str) -> Column:
    c = df[f"`{column}`"]
    return (c.isNotNull() & ~F.isnan(c)) if isinstance(df.schema[column].dataType, _FLOATS) else c.isNotNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns as null; a frame without such columns is returned as it is."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, _FLOATS)}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(df[f"`{c}`"]), df[f"`{c}`"]).alias(c) if c in floats else df[f"`{c}`"] for c in df.columns])
