"""Token ids against the tokenizers library, packing against its own rules."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, packing, pretokens
from tests.llm.support import LONG, awkward

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\r", "a", "B", "é", "ß", "1", "23", "!", "...", "<|endoftext|>",
       "<|startoftext|>", "<|", " ", "　", "漢字", "😀", "\x1c", "\x00", "\x85", "İ", "Σ", "é", "'S", "'ve", "½"]


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*texts, "a" * 4000, " " * 3000 + "x", "ab " * 200_000, *map(chr, range(1, 0x3000))]


@pytest.mark.parametrize("path, cache", [(BYTES, lambda: bpe.vocabulary(BYTES).cache), (WORDS, lambda: packing._tokens(WORDS))])
def test_ids_equal_the_library(path, cache):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in cache().ids(texts)] == want


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_PIECES", 50)
    texts = [f"word{i} and {i}" for i in range(200)]
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    cache = bpe.Vocabulary(BYTES).cache
    assert [x.tolist() for t in texts for x in cache.ids([t])] == want


def test_round_trip_of_awkward_rows(spark):
    docs = awkward(spark)
    tokenizer = Tokenizer.from_file(BYTES)
    rows = bpe.round_trip(docs, BYTES).select("text", "round_trip.*").collect()
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).isEmpty()
    assert bpe.round_trip(awkward(spark, table=False), BYTES).count() == 0


def test_packing_of_awkward_rows(spark):
    docs = awkward(spark, [f"short text {i} " * (i % 50) for i in range(300)])
    cut = packing.pieces(docs, WORDS, capacity=256, with_ids=True)
    rows = packing.pack(cut, capacity=256).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        parts = [ids[a:a + 256] for a in range(0, len(ids), 256)]
        want += [(str(r.doc_id), k, k * 256, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r.length for r in rows) // 256)
    assert least <= len(places) <= least * 1.02 + 2
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(cut, capacity=256)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)
    assert packing.pack(packing.pieces(awkward(spark, table=False), WORDS)).count() == 0


def test_each_piece_goes_where_the_sum_of_squares_is_smallest():
    lengths = np.random.default_rng(2).integers(1, 21, 300)
    number, offset = packing.place(lengths, 20)
    levels = {}
    for size, own, at in zip(lengths.tolist(), number.tolist(), offset.tolist(), strict=True):
        def total(where):
            counts = {}
            for n, level in (levels | {where: levels.get(where, 0) + size}).items():
                if level < 20:
                    counts[level] = counts.get(level, 0) + 1
            return sum(c * c for c in counts.values())

        fits = [n for n, level in levels.items() if level + size <= 20] + [-1]
        assert levels.get(own, 0) == at
        assert total(own if own in levels else -1) == min(map(total, fits))
        levels[own] = at + size


def test_long_texts_are_cut_where_no_piece_crosses():
    parts = pretokens.cut(LONG, 1000)
    assert "".join(parts) == LONG and len(parts) > 100
