"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.llm import linededup, mixing, packing, qualityrules, simhash
from rowkeel.llm.common import scratch
from rowkeel.llm.queries import quality_crf, table, tokenizer_path

#: Bytes of texts that go to a Python worker at a time.
BATCH = "1m"
#: Share of the packing caches that a worker keeps: it outlives its tasks, and so holds them through all later stages.
ROOM = 1 / 8


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage for whose session Arrow batches end at BATCH bytes, or after the row that passes them.

    Workers outlive their tasks and keep the room of their largest batch, in and out, as the executor does beside its heap:
    without a bound in bytes that is 10,000 documents of any length. The setting stays, as the stage's result is lazy.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    crf = quality_crf(docs, table(spark, sf_dir, "labels"))
    return qualityrules.keep_good(docs, crf)


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; n_chars follows the text."""
    out = linededup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays, that of the smallest doc_id."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    return mixing.repeat_documents(docs)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), max_len=2048, end_id=0, room=ROOM)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained line labels, SimHash components and packing have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as settle:
        for _, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir))
    return docs
