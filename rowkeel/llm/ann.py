"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash; equal vectors are one node that keeps its smallest ids, so large
groups of copies neither bloat the graph nor cut it apart. A shard is as large as a task's memory allows (shard_bytes), so that
there are few: a query searches each of them. Each shard's graph is built in one task and stored as one row a node with
flat neighbour arrays. To search, node rows and query rows meet by shard in sorted partitions: a task loads a shard's
graph, then streams the queries over it in batches. Shard results are merged by exact double-precision cosine.

Shards are not chosen by place: on vectors without clusters the five nearest lie all over, and asking half of 16 cells
finds 0.85 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import save

_NONE = -1


class Graph:
    """Flat neighbour arrays: layers[l] is (n, degree of l) int32, padded with -1; unit is (n, d) float32."""

    def __init__(self, unit: np.ndarray, level: np.ndarray, layers: list[np.ndarray]):
        self.unit, self.level, self.layers = unit, level, layers
        self.entry = int(np.argmax(level)) if len(level) else 0

    def beam(self, q: np.ndarray, seeds: np.ndarray, layer: int, ef: int, expand: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of many queries at once. Returns ids and similarities (B, ef), nearest first, -1 where there are none."""
        links, n, rows = self.layers[layer], len(self.unit), np.arange(len(q))[:, None]
        ids = np.full((len(q), ef), _NONE, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        seeds = seeds[:, :ef]
        ids[:, : seeds.shape[1]] = seeds
        sims[:, : seeds.shape[1]] = np.where(seeds >= 0, np.einsum("bkd,bd->bk", self.unit[seeds], q), -np.inf)
        seen = np.zeros((len(q), n + 1), bool)  # column n takes the padding
        seen[rows, ids] = True
        seen[:, n] = True
        open_ = ids >= 0
        width = min(expand, ef)
        while True:
            score = np.where(open_, sims, -np.inf)
            pick = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < ef else np.tile(np.arange(ef), (len(q), 1))
            ok = np.take_along_axis(open_, pick, 1)
            live = np.flatnonzero(ok.any(axis=1))
            if not len(live):
                break
            pick, ok = pick[live], ok[live]
            r = live[:, None]
            open_[r, pick] = False
            near = links[np.where(ok, ids[r, pick], 0)].astype(np.int64)
            near = np.where(ok[:, :, None], near, _NONE).reshape(len(live), -1)
            near[seen[r, near]] = _NONE
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = _NONE
            seen[r, near] = True
            some = np.flatnonzero((near >= 0).any(axis=1))
            if not len(some):
                continue
            live, near = live[some], near[some]
            sim = np.where(near >= 0, np.einsum("bkd,bd->bk", self.unit[near], q[live]), -np.inf)
            all_i, all_s = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], sim], 1)
            all_o = np.concatenate([open_[live], near >= 0], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_i, all_s, all_o))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[~np.isfinite(sims)] = _NONE
        return ids, sims

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Ids of near nodes (B, ef) for unit queries, nearest first."""
        at = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.beam(q, at, layer, 1)[0]
        return self.beam(q, at, 0, ef)[0]


def _spread(unit: np.ndarray, centre: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, nearest first, keep those nearer to the centre than to any kept one; fill up with the rest."""
    v = unit[ids]
    mutual = np.einsum("bkd,bjd->bkj", v, v)
    width = ids.shape[1]
    chosen = np.zeros(ids.shape, bool)
    worst = np.full(ids.shape, -np.inf, np.float32)  # similarity to the kept one nearest to each candidate
    for k in range(width):
        good = (ids[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (chosen.sum(axis=1) < keep)
        chosen[:, k] = good
        worst = np.where(good[:, None], np.maximum(worst, mutual[:, k]), worst)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=_NONE)
    return out


def build(unit: np.ndarray, *, degree: int = 16, ef: int = 48, seed: int = 5, batch: int = 512) -> Graph:
    """Insert all nodes in batches that grow with the graph; nodes of one batch also see each other."""
    n = len(unit)
    draw = np.random.default_rng(seed).random(n)
    level = np.minimum(8, (-np.log(np.maximum(draw, 1e-12)) / np.log(degree)).astype(np.int64))
    if n:
        level[0] = level.max()  # the first node is the entry
    layers = [np.full((n, degree * (2 if l == 0 else 1)), _NONE, np.int32) for l in range(int(level.max()) + 1 if n else 1)]
    g = Graph(unit, level, layers)
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + min(batch, max(1, done // 2))))
        q = unit[new]
        at = np.full((len(new), 1), g.entry, np.int64)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for layer in range(len(layers) - 1, -1, -1):
            own = level[new] >= layer
            if (~own).any():
                at[~own, :1] = g.beam(q[~own], at[~own][:, :1], layer, 1)[0]
            if own.any():
                ids, sims = g.beam(q[own], at[own], layer, ef)
                found[layer] = ids, sims
                wide = np.full((len(new), ef), _NONE, np.int64)
                wide[:, : at.shape[1]] = at[:, :ef]
                wide[own] = ids
                at = wide
        for layer, (ids, sims) in found.items():
            own = new[level[new] >= layer]
            peers = unit[own] @ unit[own].T
            np.fill_diagonal(peers, -np.inf)
            ids = np.concatenate([ids, np.tile(own, (len(own), 1))], 1)
            sims = np.concatenate([np.where(ids[:, : sims.shape[1]] >= 0, sims, -np.inf), peers], 1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            ids[~np.isfinite(sims)] = _NONE
            near = _spread(unit, unit[own], ids, sims, degree)
            _link(unit, layers[layer], own, near)
        done = int(new[-1]) + 1
    return g


def _link(unit: np.ndarray, links: np.ndarray, own: np.ndarray, near: np.ndarray) -> None:
    """Set the links of own, and add own to the lists of its neighbours, which are thinned where they overflow."""
    links[own, : near.shape[1]] = near
    src = np.repeat(own, near.shape[1])
    dst = near.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    to, start, count = np.unique(dst, return_index=True, return_counts=True)
    wide = np.full((len(to), links.shape[1] + int(count.max(initial=0))), _NONE, np.int64)
    wide[:, : links.shape[1]] = links[to]
    pos = np.arange(len(dst)) - np.repeat(start, count)
    wide[np.repeat(np.arange(len(to)), count), links.shape[1] + pos] = src
    wide.sort(axis=1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = _NONE
    wide[wide == to[:, None]] = _NONE
    full = (wide >= 0).sum(axis=1) > links.shape[1]
    packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
    links[to[~full]] = packed[~full, : links.shape[1]]
    rows = np.flatnonzero(full)
    for i in range(0, len(rows), 128):
        r = rows[i : i + 128]
        ids = packed[r]
        sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", unit[ids], unit[to[r]]), -np.inf)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * links.shape[1]]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        ids[~np.isfinite(sims)] = _NONE
        links[to[r]] = _spread(unit, unit[to[r]], ids, sims, links.shape[1])


def usable(v: Column) -> Column:
    """Not null, empty or zero, and every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


_NODES = "shard long, node int, level int, ids array<long>, v array<double>, links array<int>"


def index(vectors: DataFrame, *, k: int = 5, shard_bytes: int = 32 << 20, degree: int = 16, ef: int = 48) -> DataFrame:
    """Build the graphs over vectors(vec_id long, v array<double>): one row a distinct vector, links as flat arrays of its layers.

    A node keeps the k + 1 smallest of its vectors' ids: all that the k nearest of anything can need. shard_bytes bounds a
    shard's vectors, at 8 bytes a component, and links; vectors of each length have shards of their own.
    """
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    # The limit on row_number is applied in each task before the shuffle, so copies don't meet in one.
    few = vectors.select("vec_id", "v").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    nodes = save(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # A row for each length of vector.
    dims = nodes.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") * (8 * F.col("dim") + 12 * degree) / shard_bytes).alias("shards"))
    dealt = nodes.withColumn("dim", F.size("v")).join(F.broadcast(dims), "dim")
    dealt = dealt.withColumn("shard", F.col("dim") * F.lit(1 << 32).cast("long") + F.pmod(F.xxhash64(F.lit(3), "v"), F.col("shards")))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[x[0] for x in rows["ids"]]).sort_values("first", kind="stable").reset_index(drop=True)
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        unit = _unit(x)
        order = np.random.default_rng(len(x)).permutation(len(x))  # insertion in an order without meaning
        g = build(unit[order], degree=degree, ef=ef)
        flat = np.concatenate(g.layers, axis=1)
        upto = 2 * degree + degree * g.level
        return pd.DataFrame({"shard": rows["shard"].to_numpy()[order], "node": np.arange(len(x), dtype=np.int32), "level": g.level.astype(np.int32), "ids": rows["ids"].to_numpy()[order], "v": list(x[order]), "links": [f[:u] for f, u in zip(flat, upto)]})

    return save(dealt.select("shard", "ids", "v").groupBy("shard").applyInPandas(make, _NODES))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return np.ascontiguousarray(x / np.linalg.norm(x, axis=1, keepdims=True), np.float32)


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Double-precision cosines of q (d) with the rows of x."""
    return np.einsum("kd,d->k", x, q) / (np.sqrt(np.einsum("kd,kd->k", x, x)) * np.sqrt(np.einsum("d,d->", q, q)))


def search(nodes: DataFrame, queries: DataFrame, *, k: int = 5, ef: int = 224, degree: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries(vec_id, v) but rows of its own id."""
    shards = nodes.select("shard").distinct().groupBy(F.shiftright("shard", 32).alias("dim")).agg(F.collect_list("shard").alias("shards"))
    asked = queries.select("vec_id", "v").distinct().withColumn("dim", F.size("v").cast("long")).join(F.broadcast(shards), "dim")
    asked = asked.select(F.explode("shards").alias("shard"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("level"), F.array("vec_id").alias("ids"), "v", F.lit(None).cast("array<int>").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, graph, x, ids = None, [], None, None, None
        for b in batches:
            shard = b.column("shard").to_numpy()
            is_node = np.asarray(b.column("node").is_valid())
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (is_node[1:] != is_node[:-1])]) if len(shard) else []
            for a, z in zip(cuts, [*cuts[1:], len(shard)]):
                part = b.slice(a, z - a)
                if is_node[a]:
                    if at != shard[a]:
                        at, held, graph = shard[a], [], None
                    held.append(part)
                    continue
                if at != shard[a]:
                    continue  # cannot be: queries go to shards that exist, and nodes sort first
                if graph is None:
                    graph, x, ids = _load(held, degree)
                for i in range(0, part.num_rows, 256):
                    yield _answer(graph, x, ids, part.slice(i, 256), k, ef)

    both = nodes.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("node").asc_nulls_last())
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _load(held: list[pa.RecordBatch], degree: int) -> tuple[Graph, np.ndarray, list]:
    x = np.concatenate([_matrix(p.column("v")) for p in held])
    level = np.concatenate([p.column("level").to_numpy() for p in held])
    links = [np.asarray(l, np.int32) for p in held for l in p.column("links").to_pylist()]
    layers = [np.full((len(x), 2 * degree), _NONE, np.int32)] + [np.full((len(x), degree), _NONE, np.int32) for _ in range(int(level.max()))]
    for i, flat in enumerate(links):
        layers[0][i] = flat[: 2 * degree]
        for l in range(1, level[i] + 1):
            layers[l][i] = flat[degree * (l + 1) : degree * (l + 2)]
    return Graph(_unit(x), level, layers), x, [i for p in held for i in p.column("ids").to_pylist()]


def _answer(g: Graph, x: np.ndarray, ids: list, asked: pa.RecordBatch, k: int, ef: int) -> pa.RecordBatch:
    q = _matrix(asked.column("v"))
    own = [i[0] for i in asked.column("ids").to_pylist()]
    near = g.search(_unit(q), ef)
    out: list[tuple[int, int, float]] = []
    for b, row in enumerate(near):
        row = row[row >= 0][: 4 * k + 4]
        score = _cosine(q[b], x[row])
        got = sorted(((-s, i) for s, r in zip(score.tolist(), row.tolist()) for i in ids[r] if i != own[b]))[:k]
        out += [(own[b], i, -s) for s, i in got]
    cols = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(embeddings: DataFrame, *, every: int = 50, k: int = 5, shard_bytes: int = 32 << 20, degree: int = 16, ef_build: int = 48, ef_search: int = 224) -> DataFrame:
    """The k nearest by cosine of each row whose vec_id `every` divides, among all rows but those of its own vec_id.

    Rows of embeddings(vec_id, embedding) with a null id, or a vector that is null, empty or zero or
    holds a null or non-finite component, take no part. Ties go to the smaller vec_id. Fewer candidates
    than k: all of them. Vectors of another length than the query's are no candidates. Rows that
    repeat an id and a vector count once; several vectors of one id are asked and found each, the best counts.
    """
    v = F.col("embedding").cast("array<double>")
    rows = save(embeddings.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(usable(F.col("v"))))
    nodes = index(rows, k=k, shard_bytes=shard_bytes, degree=degree, ef=ef_build)
    return search(nodes, rows.where(F.col("vec_id") % every == 0), k=k, ef=ef_search, degree=degree)
