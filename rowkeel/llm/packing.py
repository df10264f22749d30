"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most `max_len`. Only the histogram of piece lengths, max_len
numbers, reaches the driver. There each bin opens with the longest length left, and a subset-sum dynamic
programme over bitsets finds the combination of available lengths that fills the rest best; the same
combination is removed as often as the counts allow, so there are few runs however many bins. Bins are
then handed to pieces by their rank among pieces of equal length: local ranks by partition, plus the
partition's start, so that no length, however common, passes through one task.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

_CACHE_CHUNKS, _CACHE_STEMS = 320_000, 100_000
_CACHED = 48  # longest entry kept, in characters
_LOT = 1 << 20  # bytes of texts encoded at once, but for a longer one
#: ASCII punctuation but the apostrophe, which starts contractions, and the brackets of special tokens.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


# The pre-tokenizer pattern of the vocabulary that chunks are cut for, and the names of its normalisers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file (as a dict) is of the kind that WordTokens may take apart: white space dropped, words cut by _PATTERN and closed by </w>."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    blank = [(n["pattern"], n["content"]) for n in steps if n["type"] == "Replace"]
    return (
        [n["type"] for n in steps] == _NORMALISERS
        and blank == [({"Regex": r"\s+"}, " ")]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": _PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and (spec["model"]["type"], spec["model"]["end_of_word_suffix"], spec["model"]["dropout"]) == ("BPE", "</w>", None)
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
        and all(not a["lstrip"] and not a["rstrip"] and " " not in a["content"] for a in spec["added_tokens"])
    )


class WordTokens:
    """Token ids of texts as little-endian uint32 bytes, chunk by chunk with bounded caches.

    Other tokenizers than splits_at_blanks() knows encode whole texts.

    The vocabulary drops white space and its pre-tokenizer never joins what blanks separate, so a text's ids are
    its chunks' ids in a row. Texts are cut at spaces and line feeds only: all else stays with the tokenizer.
    A-Z are lower-cased before, as the tokenizer does later, wherever that can't touch what it does first.
    A chunk of letters with ASCII punctuation after it is two pre-tokens; its letters are looked up alone. New
    letter runs are encoded many at a time and told apart by the tokens that end a word. room is the share of the
    caches' entries that are kept.
    """

    def __init__(self, path: str, room: float = 1.0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.chunks, self.stems = {"": b""}, {"": b""}
        self.most_chunks, self.most_stems = int(_CACHE_CHUNKS * room), int(_CACHE_STEMS * room)
        self.added = [a["content"].lower() for a in json.loads(self.tokenizer.to_str())["added_tokens"]]

    def _encode(self, words: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(words, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str], at_once: int = 256) -> dict[str, bytes]:
        """Ids of runs of letters."""
        out, lots = {}, [stems[i : i + at_once] for i in range(0, len(stems), at_once)]
        for lot, data in zip(lots, self._encode(["\n".join(x) for x in lots])):
            stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)
            if len(stops) == len(lot):
                out.update(zip(lot, [data[a:z] for a, z in zip([0, *stops[:-1].tolist()], stops.tolist())]))
            else:
                out.update(zip(lot, self._encode(lot)))
        return out

    def _lower(self, text: str) -> str:
        """text with A-Z lower-cased, unless an added token (matched by case) may show or NFC (which comes first) would change either form."""
        plain = text.isascii()
        low = text.lower() if plain else text.encode().lower().decode()
        if low == text or any(a in low for a in self.added):
            return text
        return low if plain or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text

    def _resolve(self, chunks: set[str]) -> dict[str, bytes]:
        pairs, whole = {}, []
        for c in chunks:
            stem = c.rstrip(_MARKS)
            plain = stem.isascii()
            if stem.isalpha() and (plain or stem.lower().isalpha()):
                pairs[c] = (stem.lower() if plain else stem), c[len(stem) :]
            else:
                whole.append(c)
        stems = self.stems
        new = self._encode_stems(list({s for s, _ in pairs.values()}.difference(stems)))
        marks = list({m for _, m in pairs.values()}.difference(stems))
        new.update(zip(marks, self._encode(marks)))
        out = dict(zip(whole, self._encode(whole)))
        for c, (s, m) in pairs.items():
            out[c] = (stems[s] if s in stems else new[s]) + (stems[m] if m in stems else new[m])
        if len(stems) < self.most_stems:
            stems.update((k, v) for k, v in new.items() if len(k) <= _CACHED)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._encode(texts)
        split = [self._lower(t).replace("\n", " ").split(" ") for t in texts]
        cache = self.chunks
        own = self._resolve(set().union(*split).difference(cache))
        full = len(cache) >= self.most_chunks
        cache.update(own)
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for k in own:
            if full or len(k) > _CACHED:
                del cache[k]
        return out


_TOKENS: dict[tuple[str, float], WordTokens] = {}


def _tokens(path: str, room: float) -> WordTokens:
    """One for each Python worker, with its cache."""
    if (path, room) not in _TOKENS:
        _TOKENS[path, room] = WordTokens(path, room)
    return _TOKENS[path, room]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut_pieces(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 0, room: float = 1.0) -> DataFrame:
    """Pieces of each row of docs(doc_id, text): ids of the text, then end_id, cut at max_len.

    part and local number the pieces of equal length within a task. Null text is empty: one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = _tokens(tokenizer, room), TaskContext.get().partitionId(), [0] * (max_len + 1)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * max_len
        for b in batches:
            lot = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // int(_LOT * room)
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, z in zip(cuts, cuts[1:]):
                ids, texts = b.column(0).slice(i, z - i).to_pylist(), [t or "" for t in b.column(1).slice(i, z - i).to_pylist()]
                out = []
                for doc, data in zip(ids, tokens.encode(texts)):
                    data += end
                    for n, at in enumerate(range(0, len(data), width)):
                        own = data[at : at + width]
                        size = len(own) // 4
                        out.append((doc, n, at // 4, size, zlib.crc32(own), part, seen[size]))
                        seen[size] += 1
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum of room or less; of equal sums, the one with longer lengths."""
    reach, steps, goal = 1, [], 1 << room
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            steps.append((length, reach))
            grown = reach | (reach << length) & mask
            if grown == reach:
                steps.pop()
                break
            reach = grown
            if reach & goal:
                break
        if reach & goal:
            break
    left, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:  # only reachable with this one
            out.append(length)
            left -= length
    return out


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until all counts are used."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        rest = fullest({n: c for n, c in counts.items() if c}, capacity - first)
        counts[first] += 1
        bin_ = sorted([first, *rest], reverse=True)
        need = {n: bin_.count(n) for n in set(bin_)}
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        out.append((bin_, times))
    return out


def _lanes(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, pieces in a bin, first bin and first offset of each run of bins that uses it."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for lengths, times in bins:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            rows.setdefault(n, []).append((rank.get(n, 0), k, first, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, *, max_len: int = 2048, end_id: int = 0, room: float = 1.0) -> DataFrame:
    """doc_id, piece int, start, length, ids_crc32, sequence_id, offset long: where each piece of docs(doc_id, text) goes.

    Sequences hold max_len tokens at most, without gaps. Ids are the tokenizer's (its special strings in a text
    included, none added), then end_id. Null and empty texts are one token. Repeated rows, also of a null
    doc_id, are packed each. An empty table gives no rows. A room below 1 shrinks the worker's caches and the texts
    encoded at once by that share, for less memory and more time; results are the same.
    """
    pieces = save(cut_pieces(docs, tokenizer, max_len, end_id, room))
    counts = save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    lanes = docs.sparkSession.sparkContext.broadcast(_lanes(pack_lengths(totals, max_len)))  # max_len runs of 63 distinct lengths at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # A row for each part, of max_len entries at most: small inputs broadcast it, large ones meet on part, which no hot length skews.
    bases = starts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                n = int(length[rows[0]])
                start, each, first, offset = lanes.value[n]
                run = np.searchsorted(start, rank[rows], "right") - 1
                bin_, slot = np.divmod(rank[rows] - start[run], each[run])
                seq[rows], off[rows] = first[run] + bin_, offset[run] + slot * n
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.element_at("bases", F.col("length")) + F.col("local")
    ranked = pieces.join(bases, "part").select("doc_id", "piece", "start", "length", "ids_crc32", rank.alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
