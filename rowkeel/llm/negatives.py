"""Hard negatives by inverted lists of k-means clusters.

Clusters are fitted on a bounded sample and hold all vectors. Each keeps the largest distance of a member from its
centroid, so that by Cauchy-Schwarz no member's inner product with an anchor exceeds the centroid's by more than the anchor's norm
times that radius. Neighbouring clusters share a shard, which one task loads; a cluster larger than a shard is spread
over several. An anchor visits a shard's clusters by falling bound, skips those whose range misses its window, and stops once the
bound falls strictly below its kth score. It asks the shard of its best cluster first; of the others only those with a cluster
whose bound reaches the kth score found there. Bounds are upper bounds, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_sample, save
from .whitening import _blocks, fitted


@dataclass
class Lists:
    """Clusters of the vectors of one length; cluster c has the number first + c in all."""

    first: int
    centroids: np.ndarray
    radii: np.ndarray | None = None
    shard: np.ndarray | None = None  # its first shard
    shards: np.ndarray | None = None  # how many it is spread over

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and the distance from it."""
        near = _nearest(x, self.centroids)
        return near, np.linalg.norm(x - self.centroids[near], axis=1)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that a member of each cluster can have with each row of a."""
        mid, norm = a @ self.centroids.T, np.linalg.norm(a, axis=1)[:, None]
        # What rounding can take from a bound is put back.
        slack = norm * (self.radii * (1 + 1e-9) + 1e-9 * (1 + np.linalg.norm(self.centroids, axis=1)))
        return mid - slack, mid + slack


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, *, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from k random rows; a centroid that loses its rows keeps its place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        live, start = np.unique(near[order], return_index=True)
        c[live] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.r_[start, len(x)])[:, None]
    return c


@dataclass
class Index:
    """nodes: shard, cluster, ids (the smallest of those that share vector and label), label, v; and the lists by length."""

    nodes: DataFrame
    lists: dict[int, Lists]
    k: int


def index(vectors: DataFrame, *, k: int = 5, max_clusters: int = 1024, sample_rows: int = 20_000, sample_bytes: int = 64 << 20, shard_bytes: int = 32 << 20, max_lengths: int = 16) -> Index:
    """Inverted lists of vectors(vec_id long, label string, v array<double>), none of them null.

    Centroids, about the root of the number of vectors and max_clusters at most, are fitted on about sample_rows vectors of sample_bytes in all;
    every vector is listed. Rows that share vector and label are one node with the k + 1 smallest ids: all that a search
    for k can return. Vectors of each length have lists of their own; more than max_lengths lengths raise ValueError.
    """
    spark = vectors.sparkSession
    first = Window.partitionBy(F.xxhash64("v", "label"), "v", "label").orderBy("vec_id")
    # The limit on row_number holds in each task before the shuffle, so copies don't meet in one.
    few = vectors.select("vec_id", "label", "v").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    own = save(few.groupBy("v", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    sizes = {r.dim: r["count"] for r in own.groupBy(F.size("v").alias("dim")).count().limit(max_lengths + 1).collect()}
    if len(sizes) > max_lengths:
        raise ValueError(f"vectors of more than {max_lengths} lengths")
    lists: dict[int, Lists] = {}
    at = 0
    for dim, n in sorted(sizes.items()):
        part = own.where(F.size("v") == dim)
        rows = bounded_sample(part, "v", max(1, min(sample_rows, sample_bytes // (8 * max(1, dim))))).select("v").toArrow()
        x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim)
        if not len(x):  # chance left all out
            x = np.zeros((1, dim))
        lists[dim] = Lists(at, kmeans(x[np.lexsort(x.T)] if dim else x, min(len(x), max_clusters, max(1, round(n**0.5)))))
        at += len(lists[dim].centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, x in _blocks(b.column("v")):
                near, far = lists[dim].assign(x)
                took = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array((near + lists[dim].first).astype(np.int32)), pa.array(far), *(took.column(c) for c in ("ids", "label", "v"))], names=["cluster", "far", "ids", "label", "v"])

    placed = save(own.select("ids", "label", "v").mapInArrow(place, "cluster int, far double, ids array<long>, label string, v array<double>"))
    stats = {r.cluster: r for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row a cluster
    tasks, shards = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    for dim, own_lists in lists.items():
        n = np.array([stats[c].n if c in stats else 0 for c in range(own_lists.first, own_lists.first + len(own_lists.centroids))])
        own_lists.radii = np.array([stats[c].far if c in stats else -np.inf for c in range(own_lists.first, own_lists.first + len(n))])
        room = min(max(1, shard_bytes // (8 * dim + 64)), max(1024, int(n.sum()) // tasks))
        own_lists.shard, own_lists.shards, shards = deal(own_lists.centroids, n, room, shards)
    told = [(own_lists.first + c, int(s), int(m)) for own_lists in lists.values() for c, (s, m) in enumerate(zip(own_lists.shard, own_lists.shards))]
    where = spark.createDataFrame(told, "cluster int, first long, many long")  # max_clusters rows a length at most
    nodes = placed.join(F.broadcast(where), "cluster").withColumn("shard", F.col("first") + F.pmod(F.xxhash64(F.lit(5), "v", "label"), F.col("many")))
    return Index(nodes.select("shard", "cluster", "ids", "label", "v"), lists, k)


def deal(centroids: np.ndarray, n: np.ndarray, room: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shard of each cluster, how many it takes, and the next free one: neighbours along the main axis share one of about `room` rows."""
    mid = centroids - centroids.mean(axis=0)
    axis = np.linalg.svd(mid, full_matrices=False)[2][0] if mid.size else np.zeros(centroids.shape[1])
    shard, shards, held = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0
    for c in np.argsort(mid @ axis, kind="stable"):
        if held and held + n[c] > room:
            first, held = first + 1, 0
        shard[c] = first
        shards[c] = max(1, -(-n[c] // room))
        if shards[c] > 1:
            first, held = first + shards[c], 0
        else:
            held += n[c]
    return shard, shards, int(first + (held > 0))


#: An anchor with its windows: the k best within [low, high] are sought for each; those below kth aren't.
_ASKED = "anchor long, label string, v array<double>, done long, windows array<struct<slot int, low double, high double, kth double>>"
_ROUTED = f"shard long, {_ASKED}"


def _route(index: Index, asked: DataFrame, again: bool) -> DataFrame:
    """asked with the shards to ask: that of the best live cluster, or again: all with a live one, but the one done before."""
    shared = asked.sparkSession.sparkContext.broadcast(index.lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, a in _blocks(b.column("v")):
                if dim not in shared.value:
                    continue
                lists, took = shared.value[dim], b.take(pa.array(rows))
                low, high = lists.bounds(a)
                done, windows, anchors = took.column("done").to_pylist(), took.column("windows").to_pylist(), took.column("anchor").to_pylist()
                at, shard = [], []
                for i in range(len(rows)):
                    live = np.flatnonzero(_live(low[i], high[i], windows[i]))
                    if not len(live):
                        continue
                    if again:
                        found = {int(s) for c in live for s in range(lists.shard[c], lists.shard[c] + lists.shards[c])} - {done[i]}
                    else:
                        best = live[high[i, live].argmax()]
                        found = {int(lists.shard[best] + anchors[i] // 7 % lists.shards[best])}
                    at += [i] * len(found)
                    shard += sorted(found)
                for i in range(0, len(at), 2048):
                    part = took.take(pa.array(at[i : i + 2048], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + 2048], pa.int64()), *part.columns], names=["shard", *part.schema.names])

    return asked.select("anchor", "label", "v", "done", "windows").mapInArrow(run, _ROUTED)


def _live(low: np.ndarray, high: np.ndarray, windows: list[dict]) -> np.ndarray:
    """Which clusters may hold one of an anchor's answers."""
    out = np.zeros(len(low), bool)
    for w in windows:
        out |= (high >= w["low"]) & (low <= w["high"]) & (high >= w["kth"])
    return out


class Shard:
    """A shard's nodes by cluster."""

    def __init__(self, lists: Lists, parts: list[pa.RecordBatch]):
        cluster = np.concatenate([p.column("cluster").to_numpy() for p in parts]) - lists.first
        order = np.argsort(cluster, kind="stable")
        self.x = np.concatenate([_blocks_one(p.column("v")) for p in parts])[order]
        ids = [i for p in parts for i in p.column("ids").to_pylist()]
        labels = np.array([l for p in parts for l in p.column("label").to_pylist()], object)
        self.ids = [ids[i] for i in order]
        self.names, self.label = np.unique(labels[order].astype(str), return_inverse=True)
        own, self.start = np.unique(cluster[order], return_index=True)
        self.stop = np.r_[self.start[1:], len(order)]
        self.lists = Lists(0, lists.centroids[own], lists.radii[own])

    def visit(self, anchor: int, label: str, a: np.ndarray, windows: list[dict], same: bool, k: int, bounds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, float]]:
        """slot, id and score of the k best of each window that aren't below its kth score."""
        low, high = bounds
        at = np.searchsorted(self.names, label)
        own = self.label == at if at < len(self.names) and self.names[at] == label else np.zeros(len(self.label), bool)
        fits = own if same else ~own
        best: list[list[tuple[float, int]]] = [[] for _ in windows]
        windows = [dict(w) for w in windows]
        order = np.argsort(-high, kind="stable")
        done, step = 0, 1
        while done < len(order):
            if high[order[done]] < min(w["kth"] for w in windows):
                break  # all further bounds are as low
            some = order[done : done + step]
            done, step = done + step, step * 2
            some = some[_live(low[some], high[some], windows)]
            if not len(some):
                continue
            rows = np.concatenate([np.arange(self.start[c], self.stop[c]) for c in some])
            rows = rows[fits[rows]]
            score = self.x[rows] @ a
            for w, held in zip(windows, best):
                near = np.flatnonzero((score <= w["high"]) & (score >= w["low"]) & (score >= w["kth"]))
                if len(near) > k + 1:  # a node may hold the anchor alone
                    near = near[score[near] >= np.partition(score[near], len(near) - k - 1)[len(near) - k - 1]]
                held += [(-s, i) for s, r in zip(score[near].tolist(), rows[near].tolist()) for i in self.ids[r] if i != anchor]
                held.sort()
                del held[k:]
                if len(held) == k:
                    w["kth"] = max(w["kth"], -held[-1][0])
        for w, held in zip(windows, best):
            yield from ((w["slot"], i, -s) for s, i in held)


def _blocks_one(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_RESULT = "anchor long, slot int, id long, score double, shard long"


def _visit(index: Index, routed: DataFrame, same: bool, max_asked: int) -> DataFrame:
    """The answers of each shard to each anchor that asks it. A shard that many ask is loaded by several tasks."""
    lists, k = index.lists, index.k
    blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / max_asked).alias("blocks"))  # a row a shard: two numbers for shard_bytes of vectors
    of = F.broadcast(blocks)
    nodes = index.nodes.join(of, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    none = F.lit(None)
    nodes = nodes.select("shard", "block", F.lit(0).alias("kind"), "cluster", "ids", "label", "v", none.cast("long").alias("anchor"), none.cast("array<struct<slot int, low double, high double, kth double>>").alias("windows"))
    asks = routed.join(of, "shard").withColumn("block", F.pmod(F.xxhash64(F.lit(11), "anchor"), F.col("blocks")))
    asks = asks.select("shard", "block", F.lit(1).alias("kind"), none.cast("int").alias("cluster"), none.cast("array<long>").alias("ids"), "label", "v", "anchor", "windows")
    shared = routed.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for b in batches:
            key = np.stack([b.column("shard").to_numpy(), b.column("block").to_numpy(), b.column("kind").to_numpy()])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if b.num_rows else []
            for i, z in zip(cuts, [*cuts[1:], b.num_rows]):
                part, own = b.slice(i, z - i), (key[0, i], key[1, i])
                if key[2, i] == 0:
                    if at != own:
                        at, held, shard = own, [], None
                    held.append(part)
                    continue
                if at != own:
                    continue  # a shard without nodes is asked by no one
                if shard is None:
                    shard = Shard(shared.value[len(held[0].column("v")[0])], held)
                yield _answers(shard, part, own[0], same, k)

    return nodes.unionByName(asks).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(run, _RESULT)


def _answers(shard: Shard, asks: pa.RecordBatch, number: int, same: bool, k: int) -> pa.RecordBatch:
    a = _blocks_one(asks.column("v"))
    low, high = shard.lists.bounds(a)
    rows = []
    for i, (anchor, label, windows) in enumerate(zip(*(asks.column(c).to_pylist() for c in ("anchor", "label", "windows")))):
        rows += [(anchor, *r, number) for r in shard.visit(anchor, label, a[i], windows, same, k, (low[i], high[i]))]
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["anchor", "slot", "id", "score", "shard"])


def search(index: Index, asked: DataFrame, *, same: bool, max_asked: int = 4096) -> DataFrame:
    """anchor, slot, rank, id, score: the index.k best of each window of asked(anchor, label, v, windows) among the vectors of
    the same label, or of the others; higher scores first, ties by smaller id. Anchors are distinct and no candidates of their own."""
    none = F.lit(None).cast("long").alias("done")
    asked = save(asked.select("anchor", "label", "v", none, "windows"))
    one = save(_visit(index, save(_route(index, asked, again=False)), same, max_asked))
    # At most k answers a slot, and as many slots as windows.
    kth = one.groupBy("anchor", "shard", "slot").agg(F.when(F.count(F.lit(1)) >= index.k, F.min("score")).alias("kth"))
    kth = kth.groupBy("anchor").agg(F.first("shard").alias("asked_shard"), F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))
    known = lambda w: F.coalesce(F.try_element_at("kths", w["slot"]), w["kth"])
    left = asked.join(kth, "anchor", "left").select("anchor", "label", "v", F.col("asked_shard").alias("done"), F.transform("windows", lambda w: F.struct(w["slot"], w["low"], w["high"], known(w).alias("kth"))).alias("windows"))
    two = _visit(index, save(_route(index, left, again=True)), same, max_asked)
    rank = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    found = one.unionByName(two).select("anchor", "slot", "id", "score").distinct()
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= index.k).select("anchor", "slot", "rank", "id", "score")


def mine(embeddings: DataFrame, *, label: Column | str = "label", every: int = 100, k: int = 5, low: int = 80, scale: float = 256.0, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each row whose vec_id `every` divides.

    A row's score is the inner product of floor(scale * component) with the anchor's. An anchor's positives are the k best other
    rows of its label; for each, its negatives are the k best rows of other labels that score at least low % of the positive and at most as much as it.
    Higher scores come first, ties by smaller vec_id.

    Rows of embeddings(vec_id, embedding, label) with a null vec_id or label, or a vector that is null or holds a null or non-finite
    component take no part. Repeated rows count once; of several anchors of one vec_id the smallest (label, vector) asks; rows of the anchor's
    vec_id are no candidates, nor are vectors of another length. A positive below 0 has no negatives. An empty table gives no rows. Scores are exact
    up to 2**53; scaled components are held within 2**40.
    """
    limit = F.lit(float(1 << 40))
    v = F.transform("embedding", lambda c: F.floor(F.greatest(-limit, F.least(limit, c.cast("double") * scale))).cast("double"))
    kind = (F.col(label) if isinstance(label, str) else label).cast("string")
    rows = embeddings.where(F.col("vec_id").isNotNull() & kind.isNotNull() & fitted(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), kind.alias("label"), v.alias("v"))
    rows = save(rows)
    lists = index(rows, k=k, **options)
    own = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor", "a.label", "a.v")
    own = save(own)
    ends = float("inf")
    window = lambda slot, a, z: F.struct(slot.cast("int").alias("slot"), a.cast("double").alias("low"), z.cast("double").alias("high"), F.lit(-ends).alias("kth"))
    positives = save(search(lists, own.withColumn("windows", F.array(window(F.lit(0), F.lit(-ends), F.lit(ends)))), same=True))
    top = F.col("score").cast("long")
    # The window's lower end is rounded up in whole numbers; k windows an anchor at most.
    ranges = positives.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window(F.col("rank"), F.ceil(top * F.lit(low).cast("decimal(5,0)") / 100), top))).alias("windows"))
    negatives = search(lists, own.join(ranges, "anchor"), same=False)
    told = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), top.alias("positive_score"))
    found = negatives.join(told, ["anchor", "slot"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))
