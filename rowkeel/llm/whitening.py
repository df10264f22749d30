"""Embedding whitening by a compensated covariance.

The mean of each dimension is the quotient of exact integer sums, held as a double and the rest of it. Vectors are centred
by it before anything is multiplied. Outer products are summed in double-double: an error-free transformation cuts the centred
columns into slices of so few bits that the matrix product of two slices over a block of rows is exact in doubles, and
exact sums with their errors add the products up. Tasks send high and low parts, which merge the same way. The covariance
is solved on the driver, once a length of vector: reduction to a tridiagonal matrix and divide and conquer (LAPACK's syevd).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

_RUN = 8192
_BLOCK, _BITS, _SLICES = 1024, 21, 5  # 2 * _BITS + log2(_BLOCK) fit in the 53 bits of a double
#: Scaled entries are held within this bound, so that they and their sums stay exact.
_LIMIT = 1 << 44


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and its error: together exactly a + b."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Columns of high + low as a sum of matrices, each a multiple of one power of two a column, of _BITS bits."""
    out = []
    top = np.abs(high).max(axis=0, initial=0.0)
    exponent = np.where(top > 0, np.frexp(top)[1], 0).astype(np.int64)  # |entries| are below 2**exponent
    for k in range(_SLICES):
        big = np.ldexp(1.5, exponent - (k + 1) * _BITS + 52)
        part = np.where(top > 0, (high + big) - big, 0.0)
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


class Gram:
    """The sum of outer products of rows, in double-double."""

    def __init__(self, dim: int):
        self.high, self.low = np.zeros((dim, dim)), np.zeros((dim, dim))

    def put(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add the outer products of the rows of high + low."""
        for at in range(0, len(high), _BLOCK):
            cut = slices(high[at : at + _BLOCK], low[at : at + _BLOCK])
            for rank in range(_SLICES + 1):  # products of like weight, the heaviest first; further ones are below 2**-120
                for k in range(max(0, rank - _SLICES + 1), rank // 2 + 1):
                    exact = cut[k].T @ cut[rank - k]
                    self.merge(exact, 0.0)
                    if k != rank - k:
                        self.merge(exact.T, 0.0)

    def merge(self, high: np.ndarray, low: np.ndarray | float) -> None:
        s, error = two_sum(self.high, high)
        self.high, self.low = two_sum(s, error + (self.low + low))


@dataclass
class Model:
    """One length of vectors: rows fitted, sums, components as columns (falling variance), and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        exact = [Fraction(s, self.n) for s in self.sums]
        self.mean = np.array([float(m) for m in exact])
        self.rest = np.array([float(m - Fraction(float(m))) for m in exact])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - sums / n as high and low parts."""
        s, error = two_sum(x.astype(np.float64), -self.mean)
        return two_sum(s, error - self.rest)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x projected; NaN where a component has no variance."""
        high, low = self.centred(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, ((high @ self.axes) + (low @ self.axes)) / np.sqrt(self.variance), np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - sums) ** 2 of each row."""
        top = max((abs(s) for s in self.sums), default=0)
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + top < 1 << 62:
            y = np.int64(self.n) * x - np.array(self.sums, np.int64)
            if np.abs(y).max(initial=0) < 1 << 52 and x.shape[1] < 1024:
                a, b = y >> 26, y & ((1 << 26) - 1)  # squares and sums of both parts stay within a long
                return [(p << 52) + (q << 27) + r for p, q, r in zip((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist())]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def fitted(v: Column) -> Column:
    """Whether a vector takes part: not null, and every entry finite."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows and matrix for each length of the vectors in a column."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat.reshape(-1, dim) if len(rows) == len(sizes) and dim else flat[starts[rows][:, None] + np.arange(dim)]


_PART = "dim int, i int, own int, high array<double>, low array<double>"


def _gram(rows: DataFrame, width, values, fan: int = 16) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Double-double outer products by length of vector; values(dim, matrix) gives high and low parts, width(dim) their columns.

    A task sends its matrix in runs of rows, of about _RUN entries each; `fan` of each run, each the merged part of many tasks, are left for
    the last merge, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for b in batches:
            for dim, _, x in _blocks(b.column("x")):
                held.setdefault(dim, Gram(width(dim))).put(*values(dim, x))
        own = TaskContext.get().partitionId() % fan
        for dim, g in held.items():
            step = max(1, _RUN // len(g.high))
            for i in range(0, len(g.high), step):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "i": pa.array([i], pa.int32()), "own": pa.array([own], pa.int32()), "high": [g.high[i : i + step].ravel()], "low": [g.low[i : i + step].ravel()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        high, low = part["high"].iloc[0], part["low"].iloc[0]
        for h, l in zip(part["high"].iloc[1:], part["low"].iloc[1:]):
            s, error = two_sum(high, h)
            high, low = two_sum(s, error + (low + l))
        return part.iloc[:1].assign(high=[high], low=[low])

    parts = rows.select("x").mapInArrow(run, _PART)
    merged = parts.groupBy("dim", "i", "own").applyInPandas(merge, _PART).groupBy("dim", "i").applyInPandas(merge, _PART)
    out: dict[int, list] = {}
    for r in merged.select("dim", "i", "high", "low").collect():  # one matrix a length
        out.setdefault(r.dim, []).append((r.i, r.high, r.low))
    return {dim: tuple(np.concatenate([r[k] for r in sorted(own)]).reshape(width(dim), -1) for k in (1, 2)) for dim, own in out.items()}


def solve(high: np.ndarray, low: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes, variances and shares of the trace of the covariance (high + low) / n, by falling variance.

    A variance that rounding alone can make is 0. Each axis' largest entry is positive.
    """
    v = (high + low) / n
    v = (v + v.T) / 2
    e, q = np.linalg.eigh(v)  # syevd: tridiagonal reduction, then divide and conquer
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    q = q * np.where(np.take_along_axis(q, np.abs(q).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    trace = fsum(np.diag(v).tolist())
    e = np.where(e > len(v) * np.finfo(float).eps * max(trace, 0.0), e, 0.0)
    return q, e, e / trace if trace > 0 else np.zeros(len(e))


def fit(rows: DataFrame, *, components: int = 32, max_dim: int = 2048, max_lengths: int = 16) -> dict[int, Model]:
    """A model for each length of the vectors in rows(x array<long>).

    Only sums and one matrix a length reach the driver: more than max_lengths lengths, or a vector of more than max_dim
    entries, raise ValueError. Empty vectors have no model.
    """
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("dim")).limit(max_lengths + 1).collect()
    if len(lengths) > max_lengths or any(r.dim > max_dim for r in lengths):
        raise ValueError(f"vectors of more than {max_lengths} lengths, or of more than {max_dim} entries")
    sums: dict[int, list] = {}
    each = rows.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "c"))
    for r in each.groupBy("dim", "i").agg(F.sum(F.col("c").cast("decimal(15,0)")).alias("s")).collect():  # a row for each dimension
        sums.setdefault(r.dim, []).append((r.i, int(r.s)))
    counts = {r.dim: r["count"] for r in lengths}
    none = np.zeros(0)
    models = {dim: Model(counts[dim], [s for _, s in sorted(own)], none, none, none) for dim, own in sums.items()}
    held = _gram(rows.where(F.size("x") > 0), lambda d: d, lambda d, x: models[d].centred(x))
    for dim, (high, low) in held.items():
        models[dim].axes, models[dim].variance, models[dim].explained = solve(high, low, counts[dim], components)

    def values(dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.nan_to_num(models[dim].whitened(x), nan=0.0)
        z = np.concatenate([z, np.ones((len(z), 1))], 1)  # the last column sums the others
        return z, np.zeros_like(z)

    for dim, (high, low) in _gram(rows.where(F.size("x") > 0), lambda d: len(models[d].variance) + 1, values).items():
        m, total = models[dim], high + low
        cov = total[:-1, :-1] / m.n - np.outer(total[-1, :-1] / m.n, total[-1, :-1] / m.n)
        live = m.variance > 0
        m.identity_error = float(np.abs(cov[np.ix_(live, live)] - np.eye(int(live.sum()))).max(initial=0.0))
    return models


def whole(v: Column, scale: float = 64.0, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset as array<long>, held within 2**44 on both sides."""
    limit = F.lit(float(_LIMIT))
    return F.transform(v, lambda c: F.floor(F.greatest(-limit, F.least(limit, c.cast("double") * scale))).cast("long") + offset)


def whiten(embeddings: DataFrame, *, components: int = 32, **options) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error: a row for each vector that takes
    part and each of its first components.

    Rows of embeddings(vec_id, embedding) whose vector is null or holds a null or non-finite entry take no part; all others
    do, repeated ones each time, whatever their vec_id. Vectors of each length are a fit list of their own; empty ones have no components. A
    component without variance (a single vector, constant or dependent entries) has a null whitened and an explained of 0, and
    doesn't count in identity_error. An empty table gives no rows. Entries beyond 2**38 count as
    2**38; a deviation of more than 38 digits is null. Equal variances: any axes of their space.
    """
    v = F.col("embedding")
    rows = save(embeddings.where(fitted(v)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(v).alias("x")))
    models = fit(rows, components=components, **options)
    spark = embeddings.sparkSession
    shared = spark.sparkContext.broadcast(models)  # at most max_lengths models of max_dim rows and `components` columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in _blocks(b.column("x")):
                if dim:
                    m = shared.value[dim]
                    z = m.whitened(x)
                    ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel(), pa.float64(), from_pandas=True))  # NaN becomes null
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array([dim] * len(x), pa.int32()), pa.array([str(y) for y in m.deviation(x)]), values], names=["vec_id", "dim", "deviation", "z"])

    found = rows.mapInArrow(run, "vec_id long, dim int, deviation string, z array<double>")
    told = [(dim, k + 1, m.n, float(m.explained[k]), m.identity_error) for dim, m in models.items() for k in range(len(m.variance))]
    told_df = spark.createDataFrame(told, "dim int, component int, n long, explained double, identity_error double")
    each = found.select("vec_id", "dim", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("k", "whitened"))
    out = each.withColumn("component", F.col("k") + 1).join(F.broadcast(told_df), ["dim", "component"])  # max_lengths * components rows at most
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
