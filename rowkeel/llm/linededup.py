"""Exact line dedup with two Bloom filters.

Pass one fills a once-seen and a twice-seen filter, sized from a count of the lines. Tasks send the positions of set bits,
so what is shuffled follows the number of distinct lines, and filters merge associatively: a bit
seen once on two sides counts as seen twice, so no repeated line is ever missed. Pass two tests each
line against the twice-seen filter; only suspects (repeats and a few false positives) are shuffled, as
128-bit digests, to be confirmed exactly and to find the first document. Texts that lose no line stay where they are:
a filter of those that do tells, and only its hits are shuffled to meet their lists of dropped lines.

A filter has max_bits at most. More lines than fit are taken in ranges of their digests, max_ranges at most, a filter and
two passes over the text for each; beyond that more suspects are shuffled, the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_of, mark_members, packed, raw, save, unpacked

_PART = 1 << 16  # bits in a filter part


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit digest of a line's key; None if the key is too short."""
    key = line.strip().lower()  # bytes: ASCII white space and A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(data: bytes, min_chars: int) -> set[bytes]:
    out = {line_key(line, min_chars) for line in data.split(b"\n")}
    out.discard(None)
    return out


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions a digest."""
    return (np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) % np.uint64(bits)).astype(np.int64)


def _pack(at: np.ndarray) -> bytes:
    """Sorted bit offsets within a part: 2 bytes each, or a bitmap (told by its length and a mark) if that is smaller."""
    if 2 * len(at) < _PART // 8:
        return b"p" + at.astype("<u2").tobytes()
    bits = np.zeros(_PART, np.uint8)
    bits[at] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    bits = np.zeros(_PART, bool)
    if data[:1] == b"p":
        bits[np.frombuffer(data, "<u2", offset=1)] = True
        return bits
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little").astype(bool)


def _in_range(digests: Iterable[bytes], turn: int, ranges: int) -> list[bytes]:
    """Those digests that belong to range number turn."""
    return [d for d in digests if ranges == 1 or d[15] % ranges == turn]


def twice_filter(docs: DataFrame, *, min_chars: int, bits: int, turn: int = 0, ranges: int = 1) -> np.ndarray:
    """Packed twice-seen filter over the distinct line keys of each row of docs(text): bits/8 bytes. With ranges: of one range of digests only."""
    if bits % _PART:
        raise ValueError(f"bits must be a multiple of {_PART}")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                digests = _in_range((d for x in b.column(0).slice(i, 256) for d in _keys(x.as_buffer().to_pybytes(), min_chars)), turn, ranges)
                if not digests:
                    continue
                pos, n = np.unique(_positions(digests, bits), axis=0, return_counts=True)
                byte, bit = pos >> 3, (1 << (pos & 7)).astype(np.uint8)
                again = (n > 1) | ((once[byte] & bit) != 0).all(axis=1)
                np.bitwise_or.at(twice, byte[again].ravel(), bit[again].ravel())
                # Two keys of this block may share single bits; that is left to the merge of whole filters, as across tasks.
                np.bitwise_or.at(once, byte.ravel(), bit.ravel())
        for part in range(bits // _PART):
            a, z = part * _PART // 8, (part + 1) * _PART // 8
            if once[a:z].any():
                own = [_pack(np.flatnonzero(np.unpackbits(x[a:z], bitorder="little"))) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own[0]], pa.binary()), pa.array([own[1]], pa.binary())], names=["part", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(np.flatnonzero(twice))], pa.binary())], names=["part", "twice"])

        for b in batches:
            for p, o, t in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if part is not None and twice.any():
                        yield done()
                    part, once, twice = p, np.zeros(_PART, bool), np.zeros(_PART, bool)
                o = _unpack(o)
                twice |= _unpack(t) | (once & o)
                once |= o
        if part is not None and twice.any():
            yield done()

    parts = docs.select(raw(F.col("text")).alias("text")).mapInArrow(fill, "part int, once binary, twice binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # bits / 8 bytes at most, however large the input
        out[r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.packbits(_unpack(bytes(r.twice)), bitorder="little")
    return out


def drop_lists(gone: DataFrame) -> DataFrame:
    """gone: key, of, digest of dropped lines. Returns _key, _of, _drop: a list for each id and text."""
    return gone.groupBy(F.col("key").alias("_key"), F.col("of").alias("_of")).agg(F.collect_set("digest").alias("_drop"))


def filter_size(docs: DataFrame, max_bits: int, max_ranges: int, line_bits: int = 16) -> tuple[int, int]:
    """Bits of a filter, a power of two, and ranges of digests, for the number of lines in docs(text): line_bits a line while they last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).agg(F.sum("n").alias("n")).first().n or 1
    need = 1 << (line_bits * lines - 1).bit_length()
    bits = min(max_bits, max(_PART, need))
    return bits, min(max_ranges, max(1, need // bits))


def _suspects(own: DataFrame, *, min_chars: int, bits: int, turn: int, ranges: int) -> DataFrame:
    """own: key, of, text. key, of, digest of the lines that the twice-seen filter of the range holds."""
    shared = own.sparkSession.sparkContext.broadcast(twice_filter(own.select("text"), min_chars=min_chars, bits=bits, turn=turn, ranges=ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids = zip(b.column(0).slice(i, 256).to_pylist(), b.column(1).slice(i, 256).to_pylist(), b.column(2).slice(i, 256))
                rows = [(k, of, d) for k, of, x in ids for d in _in_range(_keys(x.as_buffer().to_pybytes(), min_chars), turn, ranges)]
                if rows:
                    pos = _positions([d for _, _, d in rows], bits)
                    hit = np.flatnonzero(((twice[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([rows[j][k] for j in hit], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "of", "digest"])

    return own.mapInArrow(run, "key long, of long, digest binary")


def _cut(docs: DataFrame, min_chars: int, max_bits: int, max_ranges: int) -> DataFrame:
    """docs packed, with cut: text, n_lines, n_dropped."""
    # What a row drops follows from its id and its lines, so equal ids with equal texts share a list and no list exceeds the lines of one text.
    # Texts that meet in one hash share theirs, which changes nothing else: a list holds only keys that all rows of the id lose.
    key, of = key_of(F.col("doc_id")), F.xxhash64(raw(F.col("text")))
    own = docs.select(key.alias("key"), of.alias("of"), raw(F.col("text")).alias("text"))
    bits, ranges = filter_size(docs, max_bits, max_ranges)
    suspects = None
    for turn in range(ranges):
        found = save(_suspects(own, min_chars=min_chars, bits=bits, turn=turn, ranges=ranges))
        suspects = found if suspects is None else suspects.unionByName(found)
    # Written, so that the join below has shuffles of its own, of which Spark can split one that a single line fills.
    repeated = save(suspects.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first"))
    drops = save(drop_lists(suspects.join(repeated, "digest").where("key != first")))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts, drop):
        import pandas as pd

        out = []
        for data, gone in zip(texts, drop):
            lines = data.split(b"\n")
            gone = set(map(bytes, gone)) if gone is not None else ()
            stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
            out.append((b"\n".join(stay).decode("utf-8", "replace"), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    rows = mark_members(packed(docs, key=key, of=of), F.xxhash64("key", "of"), drops.select(F.xxhash64("_key", "_of")), "loses")
    text = F.coalesce(F.col("row").getField(_name(docs, "text")), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = rows.where("not loses").select("row", F.struct(text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).alias("cut"))
    # The lists of dropped keys are far smaller than the texts: they are the hashed side, and texts are never sorted.
    met = rows.where("loses").join(drops.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & (F.col("of") == F.col("_of")), "left")
    return whole.unionByName(met.select("row", cut(raw(text), F.col("_drop")).alias("cut")))


def _name(docs: DataFrame, column: str) -> str:
    """The column of docs that is meant, as it is spelt."""
    return next(c for c in docs.columns if c.lower() == column)


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, max_bits: int = 1 << 29, max_ranges: int = 4) -> DataFrame:
    """docs with text without repeated lines, and n_lines, n_dropped long.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least min_chars code
    points that two or more documents hold lose all their lines but those in the smallest doc_id. Other
    lines stay, joined by line feeds. Null text counts as one empty line and stays null; an empty one
    stays empty. Rows that repeat a doc_id are one document; so are all rows without one, after all others.
    Columns of docs named n_lines or n_dropped are replaced, all others stay.
    """
    rows = _cut(docs, min_chars, max_bits, max_ranges)
    text = _name(docs, "text")
    put = {text: F.when(F.col("row").getField(text).isNotNull(), F.col("cut.text"))}
    return unpacked(rows, docs, put, {"n_lines": F.col("cut.n_lines"), "n_dropped": F.col("cut.n_dropped")})


def drop_lines(docs: DataFrame, *, min_chars: int = 10, max_bits: int = 1 << 29, max_ranges: int = 4) -> DataFrame:
    """docs with text without repeated lines, as dedup_lines() decides; all other columns stay as they are and none is added."""
    text = _name(docs, "text")
    return unpacked(_cut(docs, min_chars, max_bits, max_ranges), docs, {text: F.when(F.col("row").getField(text).isNotNull(), F.col("cut.text"))})
