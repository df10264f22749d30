"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside joins and comparisons, so that null sorts last.
NO_ID = 2**63 - 1


def save(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowkeel-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that save() has written within the innermost scratch().
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives settle(df): saves df and then deletes every other table that save() wrote in this block, which nothing may read any more.

    The last df settled outlives the block; all else goes at its end, also after a failure.
    """
    written: list[str] = []
    last: list[str] = []

    def clear() -> None:
        for path in written:
            if path not in last:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        written[:] = last

    def settle(df: DataFrame) -> DataFrame:
        out = save(df)
        last[:] = written[-1:]
        clear()
        return out

    token = _WRITTEN.set(written)
    try:
        yield settle
    finally:
        _WRITTEN.reset(token)
        clear()


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def few_rows(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    """A DataFrame of the driver's rows; kinds: its schema, as "a string, b long".

    It goes by Arrow: from tuples, createDataFrame starts Python workers of another kind, which stay on the executors beside the operators' own.
    """
    names, types = zip(*(c.split() for c in kinds.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[t]) for c, t in zip(cols, types)], names=list(names)), kinds)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw(text: Column) -> Column:
    """The UTF-8 bytes of a text; empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def key_of(doc_id: Column) -> Column:
    """doc_id for joins: null becomes NO_ID, so null ids meet each other and sort last."""
    return F.coalesce(doc_id, F.lit(NO_ID)).cast("long")


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """row: a struct of all columns of docs, beside own columns that no name in docs can clash with. unpacked() turns it back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


def unpacked(rows: DataFrame, docs: DataFrame, put: dict[str, Column] | None = None, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of row, with those in put replaced, then the new ones in the place of any of the same name."""
    put, new = put or {}, new or {}
    names = {n.lower() for n in new}
    old = [(put[c] if c in put else F.col("row").getField(c)).alias(c) for c in docs.columns if c.lower() not in names]
    return rows.select(*old, *[c.alias(n) for n, c in new.items()])


_BITMAP = 1 << 15  # bits in one bitmap of bitmap_construct_agg


def mark_members(rows: DataFrame, of: Column, keys: DataFrame, name: str, *, max_bits: int = 1 << 30) -> DataFrame:
    """rows with boolean `name`: true wherever `of` is one of keys (a single column), and for a few more rows.

    A Bloom filter of one hash tells, with 16 bits for each key but max_bits in all, which bounds what is broadcast to
    128 MB. Rows that it rules out need no shuffle to be joined with keys. `of` is not null.
    """
    n = keys.count()
    bits = min(max_bits, max(_BITMAP, 1 << (16 * n - 1).bit_length() if n else 0))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    # Slots are dealt by bitmap before they are set, so no task sends bitmaps that are nearly empty.
    own = keys.select(slot(F.col(keys.columns[0])).alias("_slot")).select("_slot", F.bitmap_bucket_number("_slot").alias("_b")).distinct().repartition("_b")
    maps = own.groupBy("_b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_map"))
    at = F.bitmap_bit_position(slot(of))
    byte = F.conv(F.hex(F.substring("_map", (F.expr("_at div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = rows.select(F.struct("*").alias("_rows"), F.bitmap_bucket_number(slot(of)).alias("_b"), at.alias("_at"))
    met = asked.join(F.broadcast(maps), "_b", "left")
    hit = F.coalesce(F.expr("shiftright(_byte, int(_at % 8)) % 2 = 1"), F.lit(False))
    return met.withColumn("_byte", byte).withColumn("_hit", hit).select("_rows.*", F.col("_hit").alias(name))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int = 29) -> DataFrame:
    """About `rows` rows (all, if there are no more), chosen by a seeded hash of the id; reruns agree.

    The size is a binomial around `rows`, so it stays bounded however large df is.
    """
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * 2**40)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**40)) < cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, seed: int = 29, max_bytes: int = 1 << 16) -> DataFrame:
    """doc_id, text, label of about `rows` labelled documents: ids are drawn from labels, so the broadcast side is bounded.

    Labels other than 0 and 1, and those with a null id, are left out. An id of many rows gives one, that of the smallest
    text hash. Texts of more than max_bytes aren't learnt from, so the sample's size is bounded in bytes too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    few = bounded_sample(known, "doc_id", rows, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
