"""BPE encoding and decoding by dynamic programming over prefixes.

Each prefix of a piece has exactly one token that its encoding can end with. An automaton over the
vocabulary lists the tokens that end at a place; the right one is the token whose beginning has a
last token that is compatible with it, that is, merging the two tokens' bytes gives the same two
tokens back. Back-pointers from the piece's end give the ids that the merge rules would give.

Texts: None reads as empty and has no ids. Special tokens of the vocabulary are found in the text
first, as the tokenizers library does by default. Undecodable bytes decode to U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.pretokens import PieceCache, Splitter


def _byte_letters() -> dict[str, int]:
    """The public byte alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: the tokens' bytes, the merges and the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.bytes: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.specials.items()}
        self._merge: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self._merge[a, b] = rank
            self._made.setdefault(made, (rank, a, b))
        if missing := {bytes([b]) for b in range(256)} - set(raw.values()):
            raise ValueError(f"not a byte-level vocabulary: no token for {len(missing)} bytes")
        self._automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self._automaton.add_word(raw[t].decode("latin-1"), (i, len(raw[t])))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Would the merge rules leave these two tokens side by side? Remembers the answer.

        Undo the tokens' own merges from the latest back. At each step the pair that touches the
        border must not merge earlier than the step just undone; at equal rank the leftmost goes
        first, so undoing a merge on the right also forbids an equal one across the border.
        """
        a, b, limit = left, right, 1 << 60
        whole = (-1, 0, 0)
        while True:
            if self._merge.get((a, b), limit) < limit:
                fits = False
                break
            rank_a, _, tail = self._made.get(a, whole)
            rank_b, head, _ = self._made.get(b, whole)
            if rank_a < 0 and rank_b < 0:
                fits = True
                break
            if rank_a > rank_b:
                a, limit = tail, rank_a
            else:
                b, limit = head, rank_b + 1
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[left << 32 | right] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, back = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        fits, compatible = self._fits.get, self.compatible
        for at, (token, size) in self._automaton.iter(data):
            end = at + 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                before = last[begin]
                fit = fits(before << 32 | token)
                if not (compatible(before, token) if fit is None else fit):
                    continue
            last[end], back[end] = token, begin
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    @functools.cached_property
    def cache(self) -> PieceCache:
        return PieceCache(Splitter(True, list(self.specials)), list(self.specials.values()), self.encode_piece)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Once per Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The frame with each text's token ids; rows and other columns stay as they are."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = vocabulary(path).cache
        for batch in batches:
            yield pd.Series([x.astype(np.int32) for x in cache.ids(batch)], dtype=object)

    return docs.withColumn(into, run(F.col(text)))


def decode(frame: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with the text of each id list; no list reads as an empty one."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(path)
        for batch in batches:
            yield pd.Series([known.decode([] if x is None else x.tolist()) for x in batch], dtype=object)

    return frame.withColumn(into, run(F.col(ids)))


_DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "round_trip") -> DataFrame:
    """The frame with a struct n_tokens, ids_sha256, decoded_sha256 for each text.

    As `encode` followed by `decode`, but the ids stay inside the task.
    """

    @F.pandas_udf(_DIGESTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        for batch in batches:
            rows = [
                (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                 hashlib.sha256(known.decode(ids.tolist()).encode()).hexdigest())
                for ids in known.cache.ids(batch)
            ]
            yield pd.DataFrame(rows, columns=_DIGESTS.names)

    return docs.withColumn(into, run(F.col(text)))
