"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are hashed one- and two-word n-grams of the lower-cased words, and of the words' shapes (letters of a
kind become one sign), with counts scaled to unit length. A word right after itself is one n-gram for all words.
The vectors of a bounded sample of labelled rows are made in many tasks and learnt from, in order, in one; the weights are
one array of fixed size. A text's score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, raw, unpacked

_CACHE = 300_000
_SHAPE = bytes.maketrans(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b"0123456789", b"A" * 26 + b"a" * 26 + b"a" * 128 + b"9" * 10)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[bytes, tuple[int, int]] = {}


def _word_hash(word: bytes) -> tuple[int, int]:
    """Hashes of a word and of its shape, in which runs of a sign are one."""
    shape = word.translate(_SHAPE)
    shape = bytes(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])
    return xxhash.xxh64_intdigest(word.lower(), 7), xxhash.xxh64_intdigest(shape, 8)


def slots(data: bytes, bits: int) -> np.ndarray:
    """The slot of each n-gram occurrence of UTF-8 text, of 2**bits."""
    words = data.split()
    if not words:
        return np.empty(0, np.int64)
    pairs = []
    for w in words:
        h = _hashes.get(w)
        if h is None:
            h = _word_hash(w)
            if len(_hashes) < _CACHE and len(w) <= 64:
                _hashes[w] = h
        pairs.append(h)
    one = np.array(pairs, np.uint64).T
    two = (one[:, :-1] * _MIX) ^ (one[:, 1:] + _MIX)
    two[0, one[0, :-1] == one[0, 1:]] = _MIX  # a word said twice is one n-gram, whatever the word
    all_ = np.concatenate([one.ravel(), (two * _MIX).ravel()])
    return (all_ * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def vector(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and values of unit length."""
    at, n = np.unique(slots(data, bits), return_counts=True)
    x = np.sqrt(n.astype(np.float64))
    return at, x / max(1e-12, np.linalg.norm(x))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights follow from the sums z and n."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def train(sample: DataFrame, *, bits: int = 18, epochs: int = 2, seed: int = 31, tasks: int = 16) -> np.ndarray:
    """Weights (2**bits and a bias) from a bounded sample(doc_id, text, label 0 or 1), one row an id (see common.labelled_sample).

    Both labels weigh the same in all. Without rows all weights are 0. The order of learning follows from the ids alone.
    """
    rows = sample.select("doc_id", raw(F.col("text")).alias("text"), "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [vector(x.as_buffer().to_pybytes(), bits) for x in b.column(1)]
            at = pa.array([a.astype(np.int32) for a, _ in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), at, pa.array([x for _, x in own], pa.list_(pa.float64()))], names=["doc_id", "label", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(a.values.to_numpy(), x.values.to_numpy(), y) for b in batches for a, x, y in zip(b.column("at"), b.column("x"), b.column("label").to_pylist())]
        model, share = Ftrl(1 << bits), np.bincount([y for *_, y in own], minlength=2)
        for epoch in range(epochs):
            for i in np.random.default_rng(seed + epoch).permutation(len(own)):
                at, x, y = own[i]
                model.update(at, x, y, len(own) / (2 * share[y]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["w"])

    made = rows.repartition(tasks, "doc_id").mapInArrow(vectors, "doc_id long, label int, at array<int>, x array<double>")
    got = made.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id", "label").mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(got[0].w), "<f4").astype(np.float64) if got else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.3) -> DataFrame:
    """docs with score double (0 to 1, higher: label 1 likelier) and predicted int (1 from threshold on).

    Null and empty texts have no features: their score is the bias's. Texts are read whole. Columns of docs of these
    names are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w = shared.value
        out = []
        for data in texts:
            at, x = vector(data, bits)
            out.append(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -35, 35))))
        return pd.Series(out, dtype="float64")

    rows = packed(docs, s=run(raw(F.col("text"))))
    return unpacked(rows, docs, new={"score": F.col("s"), "predicted": (F.col("s") >= threshold).cast("int")})
