import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from rowkeel.llm import packing
from rowkeel.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
ODD = ["a\tb  c\r\nd\x85e f　g", "it's can't 's x'll THE'S", "é ạ̈ İ ΣΑΣ ΑΣ.", "<|endoftext|> x<|startoftext|>y <|end", "日本語 テキスト", "", "  \n", "a\x1cb\x00c", "ﬁ ½ 12.5% 3rd", "to%%% ### the&&&", "word! WORD! Word_ word…", "ǅ ß ẞ", "x" * 300 + " " + "y" * 60 + "."]


def test_tokens_equal_the_tokenizer():
    own, whole = packing.WordTokens(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aAbé .,!'&%<|\n\tñΣ1") for _ in range(80)) for _ in range(200)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want and own.encode(texts) == want  # the second time from the caches


def test_case_is_folded_before_the_caches():
    own, whole = packing.WordTokens(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())
    own.encode(["Word WORD, word, wOrd", "Äpfel äpfel ÄPFEL"])
    assert sorted(own.chunks) == ["", "word", "word,", "\u00c4pfel", "\u00e4pfel"]
    # Composed in one case only, out of order, final sigmas, special tokens in another case.
    traps = ["H\u0331A h\u0331a W\u030a", "I\u0307 \u0130 i\u0307A", "E\u0301 \u00c9 K\u212a", "\u039f\u03a3 A\u03a3 A\u03a3.", "<|EndOfText|> A", "<|endoftext|>A <|ENDOFTEXT|>", "q\u0307\u0323Q", "A\x00B\u200dC 'S IT'S"]
    assert own.encode(traps) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in traps]


def test_full_caches(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_CHUNKS", 20)
    own, whole = packing.WordTokens(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())
    for i in range(5):
        texts = [f"w{chr(97 + i)}{chr(97 + n)} same Word{n} {'x' * 60}{n}" for n in range(10)]
        assert own.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(own.chunks) == 22


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    assert packing.WordTokens(tokenizer_path()).by_chunk
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole = packing.WordTokens(path), tokenizers.Tokenizer.from_file(path)
    assert not own.by_chunk
    assert own.encode(ODD) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]


def test_fullest():
    rng = random.Random(2)
    for _ in range(100):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 20)
        got = packing.fullest(counts, room)
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(got) == best and not Counter(got) - Counter(counts)


def least_bins(counts, capacity):
    """A lower bound: large lengths are alone, and what small ones leave over after filling up middle ones."""
    items, best = list(counts.elements()), 0
    for k in range(capacity // 2 + 1):
        alone, middle = sum(x > capacity - k for x in items), [x for x in items if capacity - k >= x > capacity / 2]
        over = sum(x for x in items if capacity / 2 >= x >= k) - (len(middle) * capacity - sum(middle))
        best = max(best, alone + len(middle) + max(0, -(-over // capacity)))
    return best


def test_pack_lengths():
    rng = random.Random(3)
    for _ in range(20):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 500)))
        bins = packing.pack_lengths(dict(counts), 64)
        used = Counter()
        for lengths, times in bins:
            assert sum(lengths) <= 64
            for n in lengths:
                used[n] += times
        assert used == counts
        assert sum(t for _, t in bins) <= least_bins(counts, 64) + 3


def check(spark, texts, max_len):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, tokenizer_path(), max_len=max_len).collect()
    whole, want = tokenizers.Tokenizer.from_file(tokenizer_path()), {}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), max_len)):
            want[i, n] = (at, len(ids[at : at + max_len]), zlib.crc32(ids[at : at + max_len].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= max_len
    assert len(places) <= -(-sum(r.length for r in rows) // max_len) + 1


def test_round_trip(spark):
    rng = random.Random(4)
    check(spark, ODD + [None] + [" ".join(rng.choice("alpha beta! the of zyx".split()) for _ in range(rng.randint(0, 150))) for _ in range(200)], 64)


def test_lots(spark):
    check(spark, [None, *(f"{'alpha Beta, gamma ' * 4000}{i}" for i in range(60))], 64)  # more than packing._LOT in a task


def test_odd(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.doc_id == 6 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 1] == [1]
    assert sum(r.length for r in rows if r.doc_id == 4) >= 180_001
    assert packing.pack(no_docs, tokenizer_path()).count() == 0
