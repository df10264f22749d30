"""What changed between two versions of a table. An extension of the audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved


def table_difference(old: DataFrame, new: DataFrame, key: Sequence[str], *, buckets: int = 4096, levels: int = 2) -> DataFrame:
    """The key columns, change (added, gone, changed), n_old and n_new rows, and columns: those whose values differ (changed, and one row on each side), else null.

    Versions are bags: a key may have many rows, which are equal if the same rows occur as often on both sides, in any order. Null equals
    null, as a key too, and NaN equals NaN. Both versions have the same columns; others raise ValueError. Equal tables give no rows.

    A tree of digests finds where they differ: each row falls into one of `buckets` ** levels leaves by a hash of its key and has a digest; sums of
    digests are compared from the root's children down, and only rows of leaves that differ are shuffled and compared in full. Two different
    leaves look equal with a probability of about 2**-120. Digests are made from one scan of each version; sums are partly formed in each task.
    """
    if sorted(old.columns) != sorted(new.columns) or any(old.schema[c].dataType != new.schema[c].dataType for c in old.columns):
        raise ValueError("the two versions have different columns")
    if missing := [c for c in key if c not in old.columns]:
        raise ValueError(f"no such key column: {', '.join(missing)}")
    names = list(old.columns)
    leaf = F.pmod(F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in key]), F.lit(buckets**levels))

    def sums(df: DataFrame, sign: int) -> DataFrame:
        own = [F.col(f"`{c}`") for c in names]
        # A null and a value that is skipped hash alike: which columns are null is hashed as well.
        holes = F.concat(*[c.isNull().cast("string") for c in own])
        halves = [F.xxhash64(F.lit(s), holes, *own).cast("decimal(20,0)") for s in (101, 202)]
        part = lambda c: F.sum(c * F.lit(sign).cast("decimal(1,0)"))
        return df.groupBy(leaf.alias("_leaf")).agg(part(halves[0]).alias("_a"), part(halves[1]).alias("_b"), F.sum(F.lit(sign)).alias("_n"))

    def differs(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("_a", "_b", "_n")]).where("_a <> 0 OR _b <> 0 OR _n <> 0")

    tree = saved(sums(new, 1).unionByName(sums(old, -1)).groupBy("_leaf").agg(*[F.sum(c).alias(c) for c in ("_a", "_b", "_n")]))
    live = tree
    for level in range(levels - 1, 0, -1):  # children of the root first, then theirs
        node = tree.withColumn("_node", F.expr(f"_leaf div {buckets**level}L"))
        live = live.withColumn("_node", F.expr(f"_leaf div {buckets**level}L")).join(differs(node, "_node").select("_node"), "_node", "left_semi").drop("_node")
    leaves = saved(live.where("_a <> 0 OR _b <> 0 OR _n <> 0").select("_leaf"))
    touched = [df.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), leaf.alias("_leaf"), F.lit(sign).alias("_sign")).join(leaves, "_leaf", "left_semi") for df, sign in ((new, 1), (old, -1))]
    return _compared(touched[0].unionByName(touched[1]), key, names)


def _compared(rows: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The records of keys whose bags differ. Rows are counted by their whole value before they meet by key, so that many equal rows don't."""
    told = rows.groupBy("_key", "_row").agg(F.sum(F.when(F.col("_sign") > 0, 1).otherwise(0)).alias("_new"), F.sum(F.when(F.col("_sign") < 0, 1).otherwise(0)).alias("_old"))
    one = lambda n: F.min(F.when(F.col(n) > 0, F.col("_row")))
    met = told.groupBy("_key").agg(F.sum("_old").alias("n_old"), F.sum("_new").alias("n_new"), F.max(F.col("_old") != F.col("_new")).alias("_differs"), one("_old").alias("_was"), one("_new").alias("_is")).where("_differs")
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "gone").otherwise("changed")
    cell = lambda c: F.when(~F.col("_was")[c].eqNullSafe(F.col("_is")[c]), F.lit(c))
    columns: Column = F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), F.array_compact(F.array(*[cell(c) for c in names])))
    return met.select(*[F.col("_key")[c].alias(c) for c in key], change.alias("change"), "n_old", "n_new", columns.alias("columns"))
