"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds one bit for each language, so the AND
of an n-gram's slots gives at once every language whose filter contains it. For a text, the bits are
counted by language over all its n-grams, each count is corrected for its filter's false positives,
and the largest wins.

N-grams are four characters around each letter, lower-cased, with everything else but letters as
blanks. A language's filter takes the n-grams that make up at least `min_rate` of its own n-grams in the
training text (counted over all of it) and occur there at least 1/`contrast` as often as in any other.
At most 1/min_rate n-grams can do so, which bounds the filter's fill. The filter is built in tasks: only its
slots reach the driver, 2**20 for each 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GAP, _BLOCK = "\0\0\0", 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Whether a code point below 2**16 is a letter; surrogates are none by themselves."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def _letter_units(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which UTF-16 units belong to letters, and which of them count: of a pair that stands for one letter, the first."""
    letter = _letters()[units]
    count = letter
    high = np.flatnonzero((units[:-1] & 0xFC00 == 0xD800) & (units[1:] & 0xFC00 == 0xDC00))
    if len(high):
        points, at = np.unique(((units[high].astype(np.int64) & 0x3FF) << 10) + (units[high + 1] & 0x3FF) + 0x10000, return_inverse=True)
        high = high[np.array([chr(p).isalpha() for p in points.tolist()])[at]]
        letter, count = letter.copy(), letter.copy()
        letter[high] = letter[high + 1] = count[high] = True
    return letter, count


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four UTF-16 units around each letter, packed in 64 bits, and where each text's n-grams end."""
    lower = [t.lower() for t in texts]
    units = np.frombuffer((_GAP + _GAP.join(lower) + _GAP).encode("utf-16-le", "surrogatepass"), "<u2")
    letter, count = _letter_units(units)
    gap = units == 0
    stay = letter | gap
    stay[1:] |= letter[:-1]  # one blank after each run of letters
    kept = np.where(letter, units, 0)[stay].astype(np.uint64)
    is_letter = count[stay]
    grams = kept[:-3] | kept[1:-2] << np.uint64(16) | kept[2:-1] << np.uint64(32) | kept[3:] << np.uint64(48)
    grams = grams[is_letter[1:-2]]
    sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in lower), np.int64, len(lower))
    ends = np.cumsum(sizes + len(_GAP))
    return grams, np.r_[0, np.cumsum(count)][ends]


def _blocks(texts: list[str], size: int = _BLOCK) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _slots(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    """The slot of each n-gram under each hash; slots is a power of two."""
    shift = np.uint64(64 - (slots.bit_length() - 1))
    mixed = (grams ^ (grams >> np.uint64(29))) * _ODD[0]
    for _ in range(hashes):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[1]
        yield (mixed >> shift).astype(np.int64)


@dataclass
class LanguageFilters:
    """langs by code point, the language masks of all slots, and each filter's false-positive rate."""

    langs: list[str]
    table: np.ndarray
    hashes: int
    default: int
    rates: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        one = np.ones((), self.table.dtype)
        fill = [float(np.mean((self.table[i // 64] >> (one * (i % 64)).astype(self.table.dtype)) & one)) for i in range(len(self.langs))]
        self.rates = np.array(fill) ** self.hashes


    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text; `und` and 0 for one without letters."""
        best, score = [], []
        for a, b in _blocks(texts):
            grams, ends = _ngrams(texts[a:b])
            slots = list(_slots(grams, self.table.shape[1], self.hashes))
            n = np.diff(np.r_[0, ends])
            counts = np.empty((b - a, len(self.langs)))
            for w in range(len(self.table)):
                masks = self.table[w][slots[0]]
                for s in slots[1:]:
                    masks &= self.table[w][s]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    hits = np.r_[0, np.cumsum((masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1), dtype=np.int64)][ends]
                    counts[:, i] = np.diff(np.r_[0, hits])
            real = np.maximum(0, counts - n[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates)
            top = np.where(real.max(axis=1) > 0, real.argmax(axis=1), self.default)
            share = real[np.arange(b - a), top] / np.maximum(n, 1)
            best += ["und" if k == 0 else self.langs[t] for k, t in zip(n, top)]
            score.append(np.where(n > 0, np.clip(share, 0, 1), 0.0))
        return best, np.concatenate(score) if score else np.empty(0)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """lang, gram long, n long over all rows of labelled(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for i, j in _blocks(own):
                    grams, n = np.unique(_ngrams(own[i:j])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def choose_ngrams(counts: DataFrame, index: DataFrame, min_rate: float, contrast: float) -> DataFrame:
    """counts: lang, gram, n; index: lang, i, total. gram, i of the n-grams that each language's filter takes."""
    rated = counts.join(F.broadcast(index), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("i", "rate")).alias("own"))  # max_langs entries at most
    return top.select("gram", "top", F.explode("own").alias("o")).where((F.col("o.rate") >= min_rate) & (F.col("o.rate") * contrast >= F.col("top"))).select("gram", F.col("o.i").alias("i"))


def train(labelled: DataFrame, *, min_rate: float = 1e-5, contrast: float = 8.0, slots: int = 1 << 20, hashes: int = 2, max_langs: int = 256) -> LanguageFilters | None:
    """Fit the filters on labelled(text, lang); None if no row has both a language and a letter. More than max_langs languages raise ValueError."""
    from .common import save

    counts = save(count_ngrams(labelled))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(max_langs + 1).collect()
    if len(totals) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not totals:
        return None
    langs = [r.lang for r in totals]
    spark = labelled.sparkSession
    index = spark.createDataFrame([(r.lang, i, r.n) for i, r in enumerate(totals)], "lang string, i int, total long")  # max_langs rows at most
    chosen = choose_ngrams(counts, index, min_rate, contrast)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _slots(b.column("gram").to_numpy().view(np.uint64), slots, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column("word"), b.column("mask")], names=["slot", "word", "mask"])

    masks = chosen.groupBy("gram", F.expr("i div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(i % 64)))").alias("mask"))
    # A row a slot and 64 languages: at most slots * max_langs / 64, however much text there is.
    rows = masks.mapInArrow(place, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((-(-len(langs) // 64), slots), np.uint8 if len(langs) <= 8 else np.uint64)
    slot, word, mask = (rows.column(c).to_numpy() for c in ("slot", "word", "mask"))
    table[word, slot] = mask.view(np.uint64).astype(table.dtype)
    return LanguageFilters(langs, table, hashes, max(range(len(langs)), key=lambda i: (totals[i].n, -i)))


def identify(docs: DataFrame, model: LanguageFilters | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text).

    Null, empty and letterless texts give `und` and 0, as do all texts if there is no model. Texts are
    read whole. Ties go to the language first by code point; no known n-gram at all gives the
    language with most training text and a score of 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            langs, score = shared.value.predict(texts) if shared.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
