"""Running totals over a whole table in one order, without bringing its rows to one task. An extension of the audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import saved


def running_totals(df: DataFrame, order: Sequence[str], totals: dict[str, Column], *, whole_suffix: str = "_whole", parts: int | None = None) -> DataFrame:
    """df with a column for each of totals: its sum over all rows up to this one in the order, and one named with whole_suffix: its sum over all rows.

    order: names of columns, from small to large, or "name DESC"; nulls come first, or last with DESC. It must tell all rows apart for results that
    reruns reproduce. Null values add nothing. Columns of df named as a result are replaced. An empty table gives no rows.

    Rows are dealt by range of the order and written once, then sorted and summed within each range; the sums of the ranges, a
    row each, are added up and sent back. No exchange brings rows of df to a single partition. Rows of one order key are of one range: order by
    further columns to split a key that many rows share.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, falls = zip(*[(o.removesuffix(" DESC"), o.endswith(" DESC")) for o in order])
    by = [F.col(f"_o{i}").desc() if fall else F.col(f"_o{i}").asc() for i, fall in enumerate(falls)]
    sums = {t: f"_s{i}" for i, t in enumerate(totals)}
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(names)], *[c.alias(sums[t]) for t, c in totals.items()])
    dealt = saved(held.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    each = dealt.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums.values()])  # a row a range: n rows, whatever df holds
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = {s: F.lit(0).cast(each.schema[s].dataType) for s in sums.values()}
    starts = each.select("_part", *[x for s in none for x in (F.coalesce(F.sum(s).over(before), none[s]).alias(f"{s}_start"), F.coalesce(F.sum(s).over(whole), none[s]).alias(f"{s}_whole"))])
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.join(F.broadcast(starts), "_part")
    new = {}
    for t, s in sums.items():
        new |= {t: F.col(f"{s}_start") + F.coalesce(F.sum(s).over(within), none[s]), t + whole_suffix: F.col(f"{s}_whole")}
    return met.select(*[F.col("_row")[c].alias(c) for c in df.columns if c not in new], *[c.alias(t) for t, c in new.items()])
