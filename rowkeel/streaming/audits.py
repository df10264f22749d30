"""Streaming forms of the null profile and the foreign-key check. State is bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, is_present


def stream_null_counts(stream: DataFrame, time_column: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, n_rows and n_null_<column> of each other column, by event-time window; rows later than `late` are dropped by Spark."""
    counted = [F.count_if(is_missing(stream, c)).alias(f"n_null_{c}") for c in stream.columns if c != time_column]
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, window)).agg(F.count(F.lit(1)).alias("n_rows"), *counted)


def stream_orphans(stream: DataFrame, time_column: str, key: str, reference: DataFrame, ref_key: str, *, late: str = "10 minutes") -> DataFrame:
    """Each orphan key once within the watermark, with the time it was first seen: stream anti join static reference, then deduplicated."""
    refs = reference.where(is_present(reference, ref_key)).select(F.col(ref_key).alias("_ref")).distinct()
    keys = stream.where(is_present(stream, key)).select(F.col(key).alias("key"), F.col(time_column).alias("seen"))
    return keys.withWatermark("seen", late).join(refs, F.col("key") == F.col("_ref"), "left_anti").dropDuplicatesWithinWatermark(["key"])
