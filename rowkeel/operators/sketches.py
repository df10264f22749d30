"""Distinct counts and quantiles that can be kept and merged. An extension of the audits."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_present

_HASHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def sketch(df: DataFrame, by: Sequence[Column | str], *, distinct: Sequence[str] = (), quantiles: Sequence[str] = (), log_k: int = 12, k: int = 400) -> DataFrame:
    """by, n_rows, and a binary sketch for each column: distinct_<c> (HyperLogLog of 2**log_k registers), quantile_<c> (KLL of size k).

    Null and NaN are left out of sketches; a column without any other value has an empty or null one. Sketches have a fixed size, whatever they have
    seen, and are built in each task before the shuffle, so that a large group sends a sketch a task. An empty table gives no rows.
    """
    held = [F.count(F.lit(1)).alias("n_rows")]
    for c in distinct:
        kind = df.schema[c].dataType
        value = F.when(is_present(df, c), df[f"`{c}`"] if isinstance(kind, _HASHED) else df[f"`{c}`"].cast("string"))
        held.append(F.hll_sketch_agg(value, log_k).alias(f"distinct_{c}"))
    for c in quantiles:
        held.append(F.kll_sketch_agg_double(F.when(is_present(df, c), df[f"`{c}`"].cast("double")), k).alias(f"quantile_{c}"))
    return df.groupBy(*by).agg(*held)


def merge_sketches(sketches: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Sketches of finer groups as those of coarser ones, without their rows."""
    held = [F.sum("n_rows").alias("n_rows")]
    for c in sketches.columns:
        if c.startswith("distinct_"):
            held.append(F.hll_union_agg(c, F.lit(False)).alias(c))
        elif c.startswith("quantile_"):
            held.append(F.kll_merge_agg_double(c).alias(c))
    return sketches.groupBy(*by).agg(*held)


def read_sketches(sketches: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """sketches with the estimates n_<c> long in place of distinct_<c>, and q<percent>_<c> double in place of quantile_<c>; null for a sketch of nothing."""
    out = []
    for c in sketches.columns:
        if c.startswith("distinct_"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("long").alias(c.replace("distinct_", "n_", 1)))
        elif c.startswith("quantile_"):
            some = F.kll_sketch_get_n_double(c) > 0
            out += [F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(c)), F.lit(float(s)))).alias(f"q{round(100 * s)}_{c.removeprefix('quantile_')}") for s in shares]
        else:
            out.append(F.col(f"`{c}`"))
    return sketches.select(*out)


def distinct_error(log_k: int = 12) -> float:
    """Relative error that 999 of 1,000 merged distinct counts stay within."""
    return 3.3 * 1.04 / sqrt(2**log_k)


def rank_error(k: int = 400) -> float:
    """How far, as a share of all rows, a quantile's rank may be off; published for KLL at 99 % confidence, doubled here for safety."""
    return 2 * 2.296 / k**0.9723
