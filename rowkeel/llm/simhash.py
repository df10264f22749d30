"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join.

The join walks a binary trie of the fingerprints against itself: pairs of nodes descend together, the
bits in which they differ add up, and a pair is dropped once they exceed the error budget. The trie
is cut for Spark by pigeonhole: with at most k differing bits, one of k + 1 blocks of bits agrees, so
k + 1 tries over rotated fingerprints start at subtrees that share their first block. A subtree, or
node pair, with too many fingerprints for one task is expanded into child node pairs, again and
again, so that no task holds an unbounded group. Equal fingerprints are joined by grouping before.

Only a spanning forest leaves each task (each fingerprint with the smallest linked one of its task), so
a group of copies of any size yields rows in proportion to its members; alternating large-star and small-star
rounds then give the connected components.

Near copies by similarity (drop_near_copies) need a budget too wide for pigeonhole. There the tries stand over
the fingerprints of sets that agree in a band of minima: _BANDS tries a set however many documents there are, and a pair of
similarity 0.8 shares none with a chance of 1 in 5,000. Sets in a band of more than max_task, and those with many candidates, go down
tries over permuted fingerprints, whose subtrees share a few drawn bits, as many tries as leave a
pair of `_PLAN_BITS` differing bits a 1 in 100 chance to be missed. What tries find are candidates: their shingle
sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, key_of, mark_members, raw, save, unpacked

_CHUNK = 1 << 16
_PLAN_BITS = 12
_NEAR_BLOCK = 1 << 17  # pairs of wide budgets that a task compares, and candidates that it holds, at a time
#: Bands of a set's minima, and minima a band: sets of similarity J share a band with 1 - (1 - J ** _ROWS) ** _BANDS.
_BANDS, _ROWS = 28, 6
_TURNS = np.random.default_rng(31).integers(0, 1 << 31, _BANDS * _ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def fingerprint(data: bytes, words: int = 3) -> int:
    """64-bit SimHash of UTF-8 text: word shingles with repeats, XXH64 with seed 42, majority of each bit."""
    parts = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    text, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, _CHUNK):
        h = np.array([digest(text[a:b], 42) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of text as a long. No words, or null text: 0."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, run(raw(F.col("text"))))


def fp_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rotate(c: Column, by: int) -> Column:
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks of the 64 bits."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(fps: DataFrame, budget: int = 2, max_task: int = 100_000) -> DataFrame:
    """fps: distinct fp long. Returns src, dst long: links of a forest with the same components as all pairs at `budget` or fewer bits.

    max_task bounds the fingerprints of a trie node pair that one task takes; larger ones are split down the trie.
    """
    starts = [
        F.struct(F.lit(at).alias("rot"), F.lit(bits).alias("depth"), F.shiftrightunsigned(_rotate(F.col("fp"), at), 64 - bits).alias("a"), _rotate(F.col("fp"), at).alias("f"))
        for at, bits in _blocks(budget)
    ]
    pairs = fps.select(F.explode(F.array(*starts)).alias("t")).select("t.*").withColumn("b", F.col("a"))
    if budget == 0:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where("false")
    pairs = _split_hot(pairs, budget, max_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tasks(batches):
            src, dst = _join_tasks(rows, budget)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    keys = ["rot", "depth", "a", "b"]
    return pairs.select(*keys, "f").repartition(*keys).sortWithinPartitions(*keys, "f").mapInArrow(run, "src long, dst long").distinct()


def _split_hot(pairs: DataFrame, budget: int, max_task: int) -> DataFrame:
    """Expand node pairs of more than max_task fingerprints until there are none."""
    on, ready = ["rot", "depth", "a", "b"], []
    while True:
        sizes = pairs.groupBy(*on).count().where((F.col("count") > max_task) & (F.col("depth") < 64))
        if sizes.isEmpty():
            break
        hot = save(sizes.drop("count"))
        ready.append(pairs.join(hot, on, "left_anti"))
        pairs = save(_descend(pairs.join(hot, on, "left_semi"), budget))
    for more in ready:
        pairs = pairs.unionByName(more)
    return pairs


def _descend(pairs: DataFrame, budget: int, bits: int = 6) -> DataFrame:
    """Replace each node pair by the pairs of nodes `bits` levels further down that stay within the budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << bits) if m.bit_count() <= budget])
    down = F.least(F.lit(64) - F.col("depth"), F.lit(bits))
    # f << depth cannot overflow into wrong bits: the prefix is what falls off.
    own = F.expr(f"shiftrightunsigned(shiftleft(f, depth), 64 - least(64 - depth, {bits}))")
    split = pairs.select("*", own.alias("own"), down.alias("down"), F.explode(masks).alias("mask"), F.expr("shiftrightunsigned(f, 64 - depth)").alias("pre"))
    split = split.where("mask < shiftleft(1L, down) and bit_count(a ^ b) + bit_count(mask) <= " + str(budget))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    on_a = F.col("pre") == F.col("a")
    na = F.expr("shiftleft(a, down)").bitwiseOR(F.when(on_a, F.col("own")).otherwise(other))
    nb = F.expr("shiftleft(b, down)").bitwiseOR(F.when(on_a, other).otherwise(F.col("own")))
    same = F.col("a") == F.col("b")  # a pair of one node with itself: count each pair of children once
    return split.select("rot", (F.col("depth") + F.col("down")).alias("depth"), F.when(same, F.least(na, nb)).otherwise(na).alias("a"), F.when(same, F.greatest(na, nb)).otherwise(nb).alias("b"), *[c for c in pairs.columns if c not in ("rot", "depth", "a", "b")])


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Batches cut so that each holds whole node pairs; rows arrive sorted by them."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        rows = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if not len(rows["f"]):
            continue
        last = np.ones(len(rows["f"]), bool)
        for n in ("rot", "depth", "a", "b"):
            last &= rows[n] == rows[n][-1]
        cut = int(np.argmin(last[::-1])) if not last.all() else len(last)
        cut = len(last) - cut
        if cut:
            yield {n: np.concatenate([*(h[n] for h in held), rows[n][:cut]]) for n in rows}
            held = [{n: v[cut:] for n, v in rows.items()}]
        else:
            held.append(rows)
            # The held rows may belong to another node pair than this batch: that is found on joining.
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _near_pairs(rows: dict[str, np.ndarray], budget: int, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Descend all node pairs of rows together: indexes of the rows whose fingerprints differ in `budget` or fewer bits."""
    f, a, b, rot, depth = (rows[n] for n in ("f", "a", "b", "rot", "depth"))
    f = f.astype(np.int64).view(np.uint64)
    new = np.r_[True, (rot[1:] != rot[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(f)]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    for d in np.unique(depth[lo]):
        at = depth[lo] == d
        l, h = lo[at], hi[at]
        one = a[l] == b[l]
        # Rows of a node pair are sorted, so side a and side b are each one range; mid is where the prefix changes.
        pre = f >> np.uint64(64 - int(d)) if d else np.zeros_like(f)
        step = np.r_[False, pre[1:] != pre[:-1]]
        steps = np.r_[0, np.cumsum(step)]
        two = ~one & (steps[h] - steps[l + 1] == 1)
        mids = np.flatnonzero(step)
        mid = mids[np.searchsorted(mids, l[two] + 1)] if two.any() else l[two]
        err = np.bitwise_count(a[l[two]] ^ b[l[two]])
        start = (np.r_[l[one], l[two]], np.r_[h[one], mid], np.r_[l[one], mid], np.r_[h[one], h[two]], np.r_[np.zeros(one.sum(), np.int64), err.astype(np.int64)])
        yield from _descend_local(f, start, int(d), budget, block=block)


def _join_tasks(rows: dict[str, np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Returns each linked fingerprint with the smallest of its local component."""
    f, rot = rows["f"].astype(np.int64).view(np.uint64), rows["rot"]
    pairs = list(_near_pairs(rows, budget))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*pairs))
    turn = rot.astype(np.uint64)
    with np.errstate(all="ignore"):
        own = np.where(turn == 0, f, (f >> turn) | (f << ((np.uint64(64) - turn) & np.uint64(63))))
    nodes, at = np.unique(own[np.r_[i, j]], return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    low = np.arange(len(nodes))
    while True:  # hook roots on the smaller one, then shorten paths
        x, y = low[i], low[j]
        if (x == y).all():
            break
        m = np.minimum(x, y)
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        while (low[low] != low).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved].view(np.int64), nodes[low[moved]].view(np.int64)


def _descend_local(f: np.ndarray, start: tuple, depth: int, budget: int, leaf: int = 64, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk the frontier of node pairs (ranges of sorted f) bit by bit; small pairs are compared outright."""
    todo = [(depth, *start)]
    while todo:
        d, al, ah, bl, bh, err = todo.pop()
        if len(al) > block >> 3:  # bound the frontier: the halves are walked one after the other
            k = len(al) // 2
            todo += [(d, *(x[:k] for x in (al, ah, bl, bh, err))), (d, *(x[k:] for x in (al, ah, bl, bh, err)))]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) | (d >= 64)
        if small.any():
            yield from _compare(f, al[small], ah[small], bl[small], bh[small], budget, block)
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        ones = np.r_[0, np.cumsum((f >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        self_ = (al == bl) & (ah == bh)
        kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~self_] for x in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kids))
        live = (err <= budget) & (ah > al) & (bh > bl) & ~((al == bl) & (ah == bh) & (ah - al == 1))
        if live.any():
            todo.append((d + 1, *(x[live] for x in (al, ah, bl, bh, err))))


def _compare(f, al, ah, bl, bh, budget, block):
    """All pairs of each small node pair, in blocks of at most `block` pairs or one node pair."""
    wide = bh - bl
    sizes = (ah - al) * wide
    ends = np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block)))
        n = sizes[done:upto]
        of = np.repeat(np.arange(done, upto), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, j = al[of] + k // wide[of], bl[of] + k % wide[of]
        near = (i != j) & (np.bitwise_count(f[i] ^ f[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        done = upto


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: src, dst long. Returns node, root: the smallest node of each connected component, for every node of a link.

    Large-star and small-star rounds (minimum neighbour by grouping, then joins), each written to the
    shared folder, until nothing changes.
    """
    edges = save(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large-star: every larger neighbour goes to the minimum; small-star: every smaller one and the node itself do.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = save(small.select("e.u", "e.v").where("u != v").distinct())
        star = nxt.groupBy("u").count().where("count > 1").isEmpty() and nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        edges = nxt
        if star:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprint_roots(own: DataFrame, budget: int = 2, max_task: int = 100_000) -> DataFrame:
    """own: doc_id, fp. Returns for each distinct fp its component's root fp and the component's smallest id (NO_ID: none)."""
    fps = save(own.groupBy("fp").agg(F.min(key_of(F.col("doc_id"))).alias("first")))
    roots = components(trie_links(fps.select("fp"), budget, max_task))
    linked = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    return linked.select("fp", "root").join(least, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, *, words: int = 3, budget: int = 2, max_task: int = 100_000) -> DataFrame:
    """doc_id, fp long, component_id long (smallest doc_id reachable over links of `budget` or fewer differing bits).

    One row for each row of docs(doc_id, text). Null or wordless text: fingerprint 0, linked like any
    other. A null doc_id keeps its fingerprint and takes the component of the rest; a component of
    null ids only has a null component_id. Repeated rows share a component. An empty table gives no rows.
    """
    own = save(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words).select("doc_id", "fp"))
    of_fp = fingerprint_roots(own, budget, max_task)
    return own.join(of_fp, "fp").select("doc_id", "fp", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def _sketched(docs: DataFrame, run) -> DataFrame:
    """Written: row (a struct of all columns of docs), key, r (unique), h (hash of the text) and what run(text) gives."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, key_of(F.col("doc_id")).alias("key"), F.monotonically_increasing_id().alias("r"), F.xxhash64("text").alias("h"), run(raw(F.col("text"))).alias("s"))
    return save(own.select("row", "key", "r", "h", "s.*"))


def _without(marked: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """docs without the rows whose r is in gone(r). Rows that a filter rules out aren't shuffled."""
    gone = save(gone)
    rows = mark_members(marked.select("row", "r"), F.col("r"), gone, "maybe")
    stay = rows.where("maybe").join(gone.hint("shuffle_hash"), "r", "left_anti").select("row")
    return unpacked(rows.where("not maybe").select("row").unionByName(stay), docs)


def _losers(members: DataFrame, group: str, order: list[str]) -> DataFrame:
    """r of all members but the first by order of each group. Minima are taken in each task before the shuffle, so a large group is none there."""
    # Written, so that the join has shuffles of its own, of which Spark can split one that a single group fills.
    first = save(members.groupBy(group).agg(F.min(F.struct(*order, "r")).alias("f")).select(group, F.col("f.r").alias("first")))
    return members.select(group, "r").join(first, group).where("r != first").select("r")


def drop_near_duplicates(docs: DataFrame, *, words: int = 3, budget: int = 2, max_task: int = 100_000) -> DataFrame:
    """docs with one row of each near-duplicate group, that of its smallest doc_id (null last, then by the text's hash). Columns stay, whatever their names."""

    @F.pandas_udf("fp long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fp": np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)})

    marked = _sketched(docs, run)
    of_fp = fingerprint_roots(marked.select(F.col("key").alias("doc_id"), "fp"), budget, max_task)
    members = marked.select("key", "h", "r", "fp").join(of_fp.select("fp", "root"), "fp")
    return _without(marked, _losers(members, "root", ["key", "fp", "h"]), docs)


def shingles(data: bytes, words: int) -> set[bytes]:
    """Distinct word shingles of UTF-8 text; a shorter text is one shingle, one without words none."""
    parts = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return set()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def _sketch(data: bytes, words: int) -> tuple[int, int, int, int, np.ndarray]:
    """Digest of the shingle set, two independent SimHashes of it, its size and the digests of its bands."""
    h = np.sort(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles(data, words)), np.uint64))
    ones = np.zeros((2, 64), np.int64)
    for i in range(0, len(h), _CHUNK):
        part = h[i : i + _CHUNK]
        again = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        again = (again ^ (again >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        for k, x in enumerate((part, again ^ (again >> np.uint64(29)))):
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp, more = np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8")[:, 0].tolist()
    return xxhash.xxh3_64_intdigest(h.tobytes()), fp, more, len(h), _bands(h)


def _bands(h: np.ndarray) -> np.ndarray:
    """A digest of each band: the minima of h under _ROWS hashes."""
    short = (h >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_TURNS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(low, (short[at : at + 256, None] * _TURNS).min(axis=0), out=low)
    return np.array([xxhash.xxh32_intdigest(x.tobytes()) for x in low.reshape(_BANDS, _ROWS)], np.uint32).view(np.int32)


def _tries(n: int) -> tuple[int, np.ndarray]:
    """Bits that a subtree's fingerprints share, and a permutation of the 64 bits for each trie, for n fingerprints."""
    bits = min(20, max(4, int(0.55 * np.log2(max(n, 1)))))
    meet = float(np.prod([(64 - _PLAN_BITS - i) / (64 - i) for i in range(bits)]))
    rng = np.random.default_rng(64)
    return bits, np.array([rng.permutation(64) for _ in range(int(np.ceil(np.log(0.01) / np.log(1 - meet))))])


def _best(x: np.ndarray, y: np.ndarray, err: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `upto` nearest y of each x. A pair met again, which has the same err, counts once."""
    at = np.lexsort((y, err, x))
    at = at[np.r_[np.ones(min(len(at), 1), bool), (x[at[1:]] != x[at[:-1]]) | (y[at[1:]] != y[at[:-1]])]]
    x, y, err = x[at], y[at], err[at]
    first = np.r_[np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]
    rank = np.arange(len(x)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return x[rank < upto], y[rank < upto], err[rank < upto]


def _permuted(nodes: DataFrame, n: int, budget: int, max_task: int) -> tuple[DataFrame, np.ndarray]:
    """nodes: fp and others. The node pairs of all tries for n fingerprints, with f the permuted fingerprint, and the mask of the bits that each trie's subtrees share."""
    bits, order = _tries(n)
    rest = nodes.columns

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                part = b.slice(at, 1 << 14)
                fp = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                for rot, turn in enumerate(order):
                    f = np.packbits(np.ascontiguousarray(own[:, turn]), axis=1, bitorder="little").view("<u8")[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), rot, np.int32)), pa.array(f.view(np.int64)), *part.columns], names=["rot", "f", *rest])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    a = F.shiftrightunsigned(F.col("f"), 64 - bits)
    tries = nodes.mapInArrow(permute, f"rot int, f long, {kinds}")
    pairs = _split_hot(tries.select("rot", F.lit(bits).alias("depth"), a.alias("a"), a.alias("b"), "f", *rest), budget, max_task)
    masks = np.array([sum(1 << int(t) for t in turn[64 - bits :]) for turn in order], np.uint64)
    keys = ["rot", "depth", "a", "b"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "f"), masks


def _first_met(x: np.ndarray, rot: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether no trie before rot has both fingerprints, which differ in the bits x, in one subtree: each pair is taken once."""
    out = np.ones(len(x), bool)
    for s, mask in enumerate(masks[:-1]):
        out &= (rot <= s) | ((x & mask) != 0)
    return out


def _candidates(nodes: DataFrame, similarity: float, budget: int, upto: int, max_task: int) -> DataFrame:
    """nodes: sig, fp, more, n, bands. Returns x, y, err: for each sig the `upto` nearest at least that the tries find, each pair both ways."""
    band = F.col("band").cast("long") * F.lit(1 << 32) + F.col("digest").cast("long")
    tries = nodes.select("sig", "fp", "more", "n", F.posexplode("bands").alias("band", "digest"))
    tries = tries.select(band.alias("rot"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("fp").alias("f"), "sig", "more", "n")
    hot = save(tries.groupBy("rot").count().where(F.col("count") > max_task).select("rot"))
    crowded = not hot.isEmpty()
    few = tries.join(hot, "rot", "left_anti") if crowded else tries
    found = _nearest_in(few.repartition("rot").sortWithinPartitions("rot", "f"), similarity, budget, upto)
    if crowded:
        many = save(tries.join(hot, "rot", "left_semi").select("sig", F.col("f").alias("fp"), "more", "n").distinct())
        pairs, _ = _permuted(many, many.count(), budget, max_task)
        found = found.unionByName(_nearest_in(pairs, similarity, budget, upto))
    return found.repartition("x").distinct()


def _nearest_in(pairs: DataFrame, similarity: float, budget: int, upto: int) -> DataFrame:
    """x, y, err: for each sig of sorted node pairs the `upto` nearest of its task, each pair both ways."""
    whole = "fp" if "fp" in pairs.columns else "f"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tasks(batches):
            sig, size = rows["sig"], rows["n"]
            fp, more = (rows[c].astype(np.int64).view(np.uint64) for c in (whole, "more"))
            held, waiting = [], 0
            for i, j in _near_pairs(rows, budget, _NEAR_BLOCK):
                on = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
                i, j = i[on], j[on]
                err = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32) + np.bitwise_count(more[i] ^ more[j])
                on = err <= 2 * budget
                i, j, err = (x[on] for x in (i, j, err))
                held.append((np.r_[sig[i], sig[j]], np.r_[sig[j], sig[i]], np.r_[err, err]))
                waiting += len(i)
                if waiting > _NEAR_BLOCK:  # bound what is held to the nearest of each
                    held, waiting = [_best(*(np.concatenate(x) for x in zip(*held)), upto)], 0
            if held:
                x, y, err = _best(*(np.concatenate(x) for x in zip(*held)), upto)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(err.astype(np.int32))], names=["x", "y", "err"])

    return pairs.mapInArrow(run, "x long, y long, err int")


_SKETCH = 2048  # bits of a set's sketch by minima


def _set_sketch(h: np.ndarray) -> bytes:
    """One bit of the minimum of h under each of _SKETCH hashes: sets of similarity J agree in (1 + J) / 2 of them."""
    odd = np.random.default_rng(77).integers(0, 1 << 63, _SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(_SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 256):
        low = np.minimum(low, (h[at : at + 256, None] * odd).min(axis=0))
    return np.packbits((low >> np.uint64(31)) & np.uint64(1) > 0).tobytes()


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _crowded_links(left: DataFrame, marked: DataFrame, words: int, similarity: float, budget: int, max_task: int) -> DataFrame:
    """left: sig, fp, first, comp of the sets with many candidates. Returns src, dst: a forest of the links between their components.

    Here the sets themselves (32-bit hashes) go down the tries, so that all pairs are judged where they meet and only
    links leave a task. A sketch by minima sifts before: with four deviations, it loses a pair of exactly `similarity` in 30,000.
    """
    rows = mark_members(marked.select("r", raw(F.col("row.text")).alias("text")), F.col("r"), left.select("first"), "maybe").where("maybe")

    @F.pandas_udf("set array<int>, sketch binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            h = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(x, words)), np.uint64))
            out.append((np.unique(h.astype(np.uint32)).view(np.int32), _set_sketch(h)))
        return pd.DataFrame(out, columns=["set", "sketch"])

    own = save(left.join(rows, F.col("first") == F.col("r")).select("sig", "fp", "comp", sets("text").alias("s")).select("sig", "fp", "comp", "s.*"))
    pairs, masks = _permuted(own, own.count(), budget, max_task)
    share = (1 + similarity) / 2
    least = _SKETCH * share - 4 * (_SKETCH * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tasks(batches):
            sig, comp, rot, sets = (rows[c] for c in ("sig", "comp", "rot", "set"))
            fp = rows["fp"].astype(np.int64).view(np.uint64)
            size = np.array([len(x) for x in sets])
            sketch = np.stack([np.frombuffer(bytes(x), np.uint64) for x in rows["sketch"]])
            low: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := low.get(c, c)) != c:
                    low[c] = c = low.get(up, up)
                return c

            links = []
            for i, j in _near_pairs(rows, budget, _NEAR_BLOCK):
                on = (comp[i] != comp[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                i, j = i[on], j[on]
                on = _first_met(fp[i] ^ fp[j], rot[i], masks)
                i, j = i[on], j[on]
                for k in range(0, len(i), 1 << 15):
                    x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                    same = _SKETCH - np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                    near = np.flatnonzero(same >= least)
                    for p in near[np.argsort(-same[near], kind="stable")].tolist():
                        u, v = root(int(comp[x[p]])), root(int(comp[y[p]]))
                        if u != v and _alike(sets[x[p]], sets[y[p]], similarity):
                            low[max(u, v)] = min(u, v)
                            links.append((int(sig[x[p]]), int(sig[y[p]])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, marked: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have a Jaccard similarity of `similarity` or more."""
    ends = save(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes.select("sig", "first"), "sig"))
    rows = mark_members(marked.select("r", raw(F.col("row.text")).alias("text")), F.col("r"), ends.select("first"), "maybe").where("maybe")
    texts = save(ends.join(rows, F.col("first") == F.col("r")).select("sig", "text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = shingles(x.as_buffer().to_pybytes(), words), shingles(y.as_buffer().to_pybytes(), words)
                both = len(x & y)
                hit.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["src", "dst"]).filter(pa.array(hit, pa.bool_()))

    left = texts.select(F.col("sig").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("sig").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "x", "y").mapInArrow(judge, "src long, dst long")


def near_copy_roots(marked: DataFrame, *, words: int, similarity: float, budget: int, max_task: int, nearest: int = 2) -> DataFrame:
    """marked: r, sig, fp, more, n, bands, row.text. Returns sig, root: the component of each distinct shingle set that is linked to another.

    The `nearest` candidates of each set are confirmed by the texts. A pair that this leaves out has more candidates than that
    at both ends: such sets, those of large groups of near copies, are then judged among themselves.
    """
    nodes = save(marked.groupBy("sig").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("r").alias("first")))
    found = _candidates(nodes, similarity, budget, nearest + 1, max_task)
    ranked = save(found.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy("err", "y"))))
    pairs = ranked.where(F.col("rank") <= nearest).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = save(_confirmed(save(pairs), nodes, marked, words, similarity))
    linked = components(links)
    more = ranked.where(F.col("rank") > nearest).select(F.col("x").alias("sig")).distinct()
    if not more.isEmpty():
        left = nodes.join(more, "sig", "left_semi").join(linked, F.col("sig") == F.col("node"), "left")
        left = save(left.select("sig", "fp", "first", F.coalesce("root", "sig").alias("comp")))
        new = save(_crowded_links(left, marked, words, similarity, budget, max_task))
        if not new.isEmpty():  # the components so far, as stars, stand for all links so far
            linked = components(new.unionByName(linked.select(F.col("node").alias("src"), F.col("root").alias("dst"))))
    return linked.select(F.col("node").alias("sig"), "root")


def drop_near_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, budget: int = 24, max_task: int = 20_000) -> DataFrame:
    """docs with one row of each group of near copies, that of its smallest doc_id (null last). Columns stay, whatever their names.

    Near copies: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more, and what they link to.
    Candidates share a band of minima and differ in `budget` or fewer of the 64 bits of their SimHash; each link is confirmed by the sets. Texts without
    words, null ones included, are copies of each other.
    """

    @F.pandas_udf("sig long, fp long, more long, n long, bands array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        told = [_sketch(x, words) for x in texts]
        own = np.array([t[:4] for t in told], np.uint64).reshape(-1, 4).view(np.int64)
        return pd.DataFrame(own, columns=["sig", "fp", "more", "n"]).assign(bands=pd.Series([t[4] for t in told], dtype=object))

    marked = _sketched(docs, run)
    roots = near_copy_roots(marked, words=words, similarity=similarity, budget=budget, max_task=max_task)
    members = marked.select("key", "h", "r", "sig").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    return _without(marked, _losers(members, "root", ["key", "sig", "h"]), docs)
