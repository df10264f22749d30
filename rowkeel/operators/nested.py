"""Missing values inside nested columns, by path. An extension of the audits."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import percent


def _paths(kind: T.DataType, path: str) -> Iterator[tuple[str, list[tuple[str, str]], T.DataType]]:
    """(path, steps from the column, type) of the value itself and all values within."""

    def walk(kind: T.DataType, path: str, steps: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]], T.DataType]]:
        yield path, steps, kind
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from walk(f.dataType, f"{path}.{f.name}", [*steps, ("field", f.name)])
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, f"{path}[]", [*steps, ("each", "")])
        elif isinstance(kind, T.MapType):
            yield from walk(kind.valueType, f"{path}{{}}", [*steps, ("values", "")])

    return walk(kind, path, [])


def _values(c: Column, steps: list[tuple[str, str]]) -> tuple[Column, bool]:
    """The value at the end of steps, or all of them as an array once a step has entered an array or map."""
    many = False
    for what, name in steps:
        if what == "field":
            c = _fields(c, name) if many else c.getField(name)
        else:
            inner = (lambda x: x) if what == "each" else F.map_values
            c = F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), inner)) if many else inner(c)
            many = True
    return c, many


def _fields(c: Column, name: str) -> Column:
    return F.transform(c, lambda x: x.getField(name))


def json_schema(df: DataFrame, column: str) -> str:
    """The DDL of the JSON values in a text column, from one scan: what is text in some rows and a number in others is variant."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`"))).alias("s")).first().s or "VOID"
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found))


def nested_null_profile(df: DataFrame, columns: list[str], *, json: tuple[str, ...] = ()) -> DataFrame:
    """path, n_null, n_rows, pct_null for each column and each value within: `.name` of structs, `[]` elements of arrays, `{}` values of maps.

    n_rows of a path outside arrays and maps is that of the table: a field of a missing struct is missing. Within them it is the number of elements or values
    that there are, in arrays that are there. NaN is missing. Columns named in json are text that holds JSON: their schema is found by one scan, JSON null and absent names
    are missing, text that is no JSON is missing as a whole. An empty table has a row for each path, and a null pct_null. All paths are counted in one scan.
    """
    values = df.select(*[F.try_parse_json(F.col(f"`{c}`")).alias(c) if c in json else F.col(f"`{c}`") for c in columns])
    kinds = {}
    for c in columns:
        if c in json:
            kinds[c] = json_schema(df, c)
            values = values.withColumn(c, F.try_variant_get(F.col(f"`{c}`"), "$", kinds[c]))
    each: list[tuple[str, Column, Column]] = []
    for c in columns:
        for path, steps, kind in _paths(values.schema[c].dataType, c):
            v, many = _values(F.col(f"`{c}`"), steps)
            missing = (lambda x: x.isNull() | F.isnan(x)) if isinstance(kind, (T.FloatType, T.DoubleType)) else (lambda x: F.is_variant_null(x) | x.isNull()) if isinstance(kind, T.VariantType) else (lambda x: x.isNull())
            if many:
                n = F.coalesce(F.sum(F.when(v.isNotNull(), F.size(v)).otherwise(0)), F.lit(0))
                each.append((path, F.coalesce(F.sum(F.when(v.isNotNull(), F.size(F.filter(v, missing))).otherwise(0)), F.lit(0)), n))
            else:
                each.append((path, F.count_if(missing(v)), F.count(F.lit(1))))
    counted = values.agg(*[x.cast("long").alias(f"{k}{i}") for i, (_, a, n) in enumerate(each) for k, x in (("a", a), ("n", n))])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"a{i}").alias("n_null"), F.col(f"n{i}").alias("n_rows")) for i, (p, _, _) in enumerate(each)])
    return counted.select(F.inline(rows)).withColumn("pct_null", percent(F.col("n_null"), F.col("n_rows")))
