"""Overlapping chunks of words with exact offsets, by JVM functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with the ASCII white space after it; what stands before the first word is of none.
_TOKEN = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
_BLANKS = r"[\x20\x09-\x0D]+"


def chunk_words(docs: DataFrame, text: str = "text", *, size: int = 200, overlap: int = 40) -> DataFrame:
    """docs without text, with chunk int from 0, start and end long (code points of the text, end exclusive), n_words int and chunk_text: a row a chunk.

    Chunks have `size` words and share `overlap` of them with the next one; the last may be shorter, but holds a word that none before it has. chunk_text is the text from start to end,
    from the first letter of the first word to the last of the last. Chunks cover all words, whole texts are read, and a null, empty or blank text has none. Columns of docs named as a
    result are replaced.

    A document is one row until its chunks are told: words are cut once, block lengths give the offsets, and slices the chunks. Memory is that of the document.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and less than size")
    step = size - overlap
    own = ("chunk", "start", "end", "n_words", "chunk_text")
    kept = [c for c in docs.columns if c not in own and c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({_TOKEN})"), 1).alias("w"), F.length(F.regexp_extract(F.col(f"`{text}`"), f"^{_BLANKS}", 0)).cast("long").alias("lead"))
    rows = rows.where(F.size("w") > 0).withColumn("n", F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / F.lit(step))).cast("int"))
    block = lambda b, many: F.array_join(F.slice("w", b * step + 1, F.lit(many)), "")
    # Lengths of blocks of `step` words, then where each block starts: as many numbers as chunks.
    sizes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.length(block(b, step)).cast("long"))
    rows = rows.withColumn("sizes", sizes)
    at = F.aggregate("sizes", F.array(F.col("lead")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    rows = rows.withColumn("at", at)
    # Read from twice, so that Catalyst makes each of these arrays once a row.
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.struct(b.alias("chunk"), F.get("at", b).alias("start"), F.regexp_replace(block(b, size), rf"{_BLANKS}\z", "").alias("chunk_text"), F.least(F.lit(size), F.size("w") - b * step).alias("n_words")))
    told = rows.select("row", F.explode(each).alias("c")).select("row", "c.*")
    out = [F.col("row")[c].alias(c) for c in kept]
    return told.select(*out, "chunk", "start", (F.col("start") + F.length("chunk_text")).alias("end"), "n_words", "chunk_text")
