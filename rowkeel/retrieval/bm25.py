"""Ranking documents for text queries by an inverted index and BM25."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import saved

#: A word: letters of any script and digits.
_WORD = r"([\p{L}\p{N}]+)"
#: Words of documents that a task counts, and scores that a task holds, at most: tasks grow in number, not in size.
_TASK_WORDS, _TASK_SCORES = 1 << 21, 1 << 19


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 1)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is taken once a row however often then names it."""
    return F.transform(F.array(value), then)[0]


def _counts(w: Column) -> Column:
    """The distinct words of an array with how often each stands there: array<struct<term, tf int>>."""
    first = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda p: ~p["term"].eqNullSafe(F.get(s, p["at"] - 1)))
    until = lambda s, runs, j: F.coalesce(F.get(runs, j + 1)["at"], F.size(s))
    sized = lambda s, runs: F.transform(runs, lambda p, j: F.struct(p["term"].alias("term"), (until(s, runs, j) - p["at"]).alias("tf")))
    return _once(F.sort_array(w), lambda s: _once(first(s), lambda runs: sized(s, runs)))


def rank_documents(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75, max_terms: int = 200_000) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query that share a word with it; ties go to the smaller doc_id.

    score long: the sum over the query's distinct words of ln(1 + (N - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), each in millionths, rounded, so that the
    order of additions doesn't matter. Rows that share an id are one document, or one query. Rows with a null id are left out; null and wordless texts have no postings, but count
    as documents. Empty tables give no rows.

    Postings hold the words that queries ask for, one row a document, dealt by document. Query words, in blocks of max_terms rows, are sent to them, so that no word,
    however frequent, is a key of a shuffle; a document's scores are then summed where it lies, and each task keeps the k best of a query before they meet.
    Words are counted within a row before they are dealt. A task counts about _TASK_WORDS words and holds about _TASK_SCORES scores, or those of one document, at any size of docs: the
    number of tasks follows from counts, neither from spark.sql.shuffle.partitions nor from bytes shuffled, which don't show how far postings spread over queries.
    """
    least = max(2, docs.sparkSession.sparkContext.defaultParallelism)  # one partition would be no dealing by document
    asked = saved(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.explode(words(F.col(text))).alias("term")).distinct())
    vocabulary = asked.select("term").distinct()
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), words(F.col(text)).alias("w"))
    lengths = saved(own.select("d", F.greatest(F.size("w"), F.lit(0)).cast("long").alias("tf")))
    n_words = lengths.agg(F.sum(F.col("tf") + 1)).first()[0] or 0
    n_terms = asked.count()
    few = n_terms <= max_terms
    terms = own.select("d", F.inline(_counts(F.col("w")))).withColumn("tf", F.col("tf").cast("long"))
    met = terms.join(F.broadcast(vocabulary) if few else vocabulary, "term", "left_semi")
    # A document's length goes along as that of no word, so that nothing has to be joined.
    rows = met.unionByName(lengths.withColumn("term", F.lit(None).cast("string"))).repartition(max(least, -(-n_words // _TASK_WORDS)), "d")
    counted = rows.groupBy("d", "term").agg(F.sum("tf").alias("tf"))
    length, word = F.when(F.col("term").isNull(), F.col("tf")), F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    postings = saved(counted.groupBy("d").agg(F.sum(length).alias("size"), F.collect_list(word).alias("terms")))
    total = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    mean = (total.words or 0) / max(1, total.n)
    # A row a word that queries ask for.
    df = postings.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = -(-n_terms // max_terms) or 1
    part = F.pmod(F.xxhash64(F.lit(3), "q"), F.lit(parts)).alias("part")
    idf = saved(asked.join(df, "term").select("q", "term", "df", part, F.log1p((F.lit(float(total.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    # The scores of a block: no more than its meetings of a query word and a posting, nor than a score a query and document.
    scores = {r.part: min(r.met, r.asking * total.n) for r in idf.groupBy("part").agg(F.sum("df").alias("met"), F.count_distinct("q").alias("asking")).collect()}
    weight = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(mean or 1.0)))
    found = []
    for part in range(parts):
        block = (idf if parts == 1 else idf.where(F.col("part") == part)).select("q", "term", "idf")
        own = postings.repartition(max(least, -(-scores.get(part, 0) // _TASK_SCORES)), "d").select("d", "size", F.inline("terms"))
        scored = own.join(F.broadcast(block), "term").groupBy("d", "q").agg(F.sum(F.round(weight * 1e6).cast("long")).alias("score"))
        best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
        found.append(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("q").alias(query_id), "rank", F.col("d").alias(doc_id), "score")
