"""Benchmark decontamination: Wu-Manber search for all windows of a benchmark in documents, over words.

The alphabet is words, not characters: a window is ten of them. For the windows of each length, a table holds how far a
block of words (two of them) allows the search to move on; a block that no window holds moves it by almost a whole window. Where a
block ends a window, the last words choose a bucket of windows, and the words before them are compared directly.

A benchmark that is larger than one task should hold is searched part by part: each part's windows are sent to all tasks,
whose size is bounded, and go over all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, raw, save, unpacked

Window = tuple[bytes, ...]
#: Bytes as the search sees them: A-Z in lower case, digits, letters and all of non-ASCII as they are, the rest blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_TABLE).split()


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """Each run of `size` words, or all of fewer words; none without words. Words are space-joined."""
    w = words(text)
    for i in range(max(1, len(w) - size + 1) if w else 0):
        yield b" ".join(w[i : i + size])


class _SameLength:
    """The tables for windows of one length."""

    def __init__(self, size: int, rows: Iterable[tuple[Window, Sequence[str]]], block: int, suffix: int):
        self.size, self.block, self.suffix = size, min(block, size), min(max(block, suffix), size)
        self.far = size - self.block + 1
        self.shift: dict[Window, int] = {}
        self.buckets: dict[Window, dict[Window, Sequence[str]]] = {}
        for window, items in rows:
            for end in range(self.block, size + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), size - end)
            # Within a bucket the other words are the key: equal ones are told by comparison, however many share the suffix.
            self.buckets.setdefault(window[size - self.suffix :], {})[window[: size - self.suffix]] = items

    def find(self, text: list[bytes]) -> Iterator[tuple[int, Sequence[str]]]:
        """Where windows start, in order, and the items they come from."""
        size, block, suffix, far, shift, buckets = self.size, self.block, self.suffix, self.far, self.shift, self.buckets
        at, n = size, len(text)
        while at <= n:
            step = shift.get(tuple(text[at - block : at]), far)
            if step:
                at += step
                continue
            bucket = buckets.get(tuple(text[at - suffix : at]))
            if bucket is not None and (items := bucket.get(tuple(text[at - size : at - suffix]))) is not None:
                yield at - size, items
            at += 1


class Search:
    """All windows, by length."""

    def __init__(self, rows: Iterable[tuple[bytes, Sequence[str]]], block: int = 2, suffix: int = 5):
        by: dict[int, list[tuple[Window, Sequence[str]]]] = {}
        for joined, items in rows:
            window = tuple(joined.split(b" "))
            by.setdefault(len(window), []).append((window, items))
        self.groups = [_SameLength(n, by[n], block, suffix) for n in sorted(by)]

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words that windows cover, disjoint and in order, and the items of those windows."""
        found, items = [], set()
        for g in self.groups:
            runs: list[list[int]] = []
            for start, own in g.find(text):
                items.update(own)
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = start + g.size
                else:
                    runs.append([start, start + g.size])
            found += runs
        return joined(found), items


def joined(runs: Iterable[Sequence[int]]) -> list[tuple[int, int]]:
    """Overlapping or adjoining runs become one."""
    out: list[list[int]] = []
    for a, z in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """win binary, item string: the distinct windows of benchmark(item_id, text) with their items.

    Null, empty and wordless texts have none. A null item_id leaves item null: its windows count as hits, but name no item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = list(dict.fromkeys(windows(text, size)))
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["win", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), raw(F.col("text")).alias("t")).mapInArrow(run, "win binary, item string").distinct()


#: The tables of the broadcast last searched for; Python workers outlive their tasks.
_HELD: dict[str, Search] = {}


def _search(shared: Broadcast) -> Search:
    if shared.value[0] not in _HELD:
        _HELD.clear()
        _HELD[shared.value[0]] = Search(shared.value[1])
    return _HELD[shared.value[0]]


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _finder(shared: Broadcast):
    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        search, rows = _search(shared), []
        for t in texts:
            w = words(t)
            spans, items = search.spans(w)
            rows.append((len(w), [a for a, _ in spans], [z for _, z in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return run


def _union():
    @F.pandas_udf("starts array<int>, ends array<int>")
    def run(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = [joined(zip(s, e)) for s, e in zip(starts, ends)]
        return pd.DataFrame({"starts": [[a for a, _ in r] for r in rows], "ends": [[z for _, z in r] for r in rows]})

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, max_windows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items long, items array<string> (sorted), spans array<struct<start, end>> (words that
    windows cover, end exclusive, disjoint), and contaminated boolean (any hit).

    A window is `size` consecutive words of a benchmark text, or all of a text of fewer. Null, empty and wordless texts
    have no words and no windows; an empty benchmark hits nothing. Repeated items and texts count once, repeated documents each.
    Texts are read whole. Columns of docs of these names are replaced, all others stay.

    At most about max_windows pairs of window and item, of about max_bytes in all, are sent to a task at once; a larger benchmark
    goes over all documents part by part, and only rows with hits are written for each.
    """
    spark = docs.sparkSession
    pairs = save(benchmark_windows(benchmark, size))
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("win") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0)).alias("size")).first()
    parts = max(1, -(-total.n // max_windows), -(-total.size // max_bytes))

    def sent(part: int) -> Broadcast:
        own = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64(F.lit(7), "win", "item"), F.lit(parts)) == part)
        held: dict[bytes, list[str]] = {}
        for win, item in own.toLocalIterator():
            named = held.setdefault(bytes(win), [])
            if item is not None:
                named.append(item)
        return spark.sparkContext.broadcast((uuid.uuid4().hex, list(held.items())))

    if parts == 1:
        rows = packed(docs, s=_finder(sent(0))(raw(F.col("text"))))
    else:
        base = save(packed(docs, t=raw(F.col("text")), n=F.monotonically_increasing_id()))
        found = []
        for part in range(parts):
            shared = sent(part)
            hits = base.select("n", _finder(shared)("t").alias("s")).select("n", "s.*")
            found.append(save(hits.where((F.size("starts") > 0) | (F.lit(part) == 0))))
            shared.destroy()
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
        met = reduce(DataFrame.unionByName, found).groupBy("n").agg(F.first("n_words").alias("n_words"), *flat)
        met = met.select("n", "n_words", _union()("starts", "ends").alias("u"), F.array_sort(F.array_distinct("items")).alias("items"))
        # Each row of docs has one in met: part 0 keeps all.
        rows = base.select("row", "n").join(met, "n").select("row", F.struct("n_words", "u.starts", "u.ends", "items").alias("s"))
    spans = F.transform(F.arrays_zip("s.starts", "s.ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")))
    hit = F.aggregate(F.zip_with("s.starts", "s.ends", lambda a, z: (z - a).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    new = {"n_words": F.col("s.n_words"), "n_hit": hit, "n_items": F.size("s.items").cast("long"), "items": F.col("s.items"), "spans": spans, "contaminated": F.size("s.starts") > 0}
    return unpacked(rows, docs, new=new)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, **options) -> DataFrame:
    """The rows of docs of whose words at most max_share are hit; rows without words stay."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return find_overlaps(own, benchmark, **options).where(F.col("n_hit") <= max_share * F.col("n_words")).select("row.*")
