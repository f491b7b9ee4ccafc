"""Jaccard join of word n-gram sets by parity sketches.

A set's sketch is a row of blocks; every n-gram's hash is XORed into the block that the hash itself
chooses. Each n-gram that only one of two sets has changes one block at most, so the number of
differing blocks is a lower bound of the symmetric difference. Two sets of likeness t whose smaller
size is at most h differ by at most D = h(1 - t)/t n-grams; of D + 1 + z blocks at least z + 1 are
equal. So sets are dealt into bands by size (partners stand in the same band or the next), sketched
with as many blocks as their band needs, and joined on equal blocks. z covers blocks that stay
empty; a set with more than z of them also joins on its empty blocks, so none is missed. A second
sketch of 1,024 single bits, whose Hamming distance is a lower bound as well, sorts candidates out
before the sets themselves are compared.

N-grams are told apart by 64-bit hashes. Sets that are equal are put together first.

Results: one row per input row. A null text has no words; without words a row has an empty set and
links with nothing. A null id links with nothing and has no component. Rows that repeat an id share
their links. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import materialize
from gridloom.llm.graph import by_ids, components, link

_ODD = 0x9E3779B97F4A7C15
#: Texts longer than this many bytes are hashed in parts.
PART = 1 << 20
#: Signed numbers of 64 bits that hold the second sketch: the more bits, the fewer n-grams fall together in one
#: and hide each other, so sets just below the threshold are told apart before they are compared.
SKETCH = 16
_BITS = [f"p{k}" for k in range(SKETCH)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, which bytes are white space, powers of an odd number and of its inverse."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    powers = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        row = np.ones(1, np.uint64)
        while len(row) < PART * 2:
            row = np.concatenate([row, row * np.uint64(pow(base, len(row), 1 << 64))])
        powers.append(row)
    return np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64), space, *powers


def placed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of at most 2 PART bytes, and where they begin."""
    values, space, powers, inverse = _tables()
    codes = np.frombuffer(data, np.uint8)
    word = np.zeros(len(codes) + 2, np.int8)
    word[1:-1] = ~space[codes]
    edge = np.diff(word)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values[codes] * powers[:len(codes)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * inverse[begin]), begin


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words: runs without ASCII white space, A-Z in lower case."""
    data = (text or "").encode("utf-8", "replace").lower()
    out, at = [], 0
    while at < len(data):
        part = data[at:at + PART]
        if at + PART < len(data):
            # end at white space, unless a single word is longer than a part
            cut = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            if cut <= 0:
                # a word of a megabyte: to its end, by Python's own hash of the bytes
                word = data[at:].split(maxsplit=1)[0]
                out.append(np.array([int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")], np.uint64))
                at = data.index(word, at) + len(word)
                continue
            part = part[:cut]
        at += len(part)
        out.append(placed_words(part)[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams; with fewer words, of the whole sequence."""
    h = word_hashes(text)
    width = min(words, len(h))
    if not width:
        return h
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mix(total * np.uint64(_ODD) + h[k:len(h) - width + 1 + k])
    return np.unique(total)


class Bands:
    """Bands of set sizes for a threshold of `percent`, and the blocks each needs."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [1]
        while self.tops[-1] < 1 << 40:
            top = self.tops[-1]
            self.tops.append(max(top + 1, top * 100 // percent))
        self._array = np.array(self.tops)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self._array, size))

    @functools.cache  # noqa: B019  (one object per task)
    def blocks(self, band: int) -> tuple[int, int]:
        """The number of blocks for pairs whose smaller set is in the band, and z."""
        low, top = (self.tops[band - 1] + 1 if band else 1), self.tops[band]
        differ = top * (100 - self.percent) // self.percent
        if not differ:
            return 0, 0  # only equal sets can be alike
        empty = (differ + 1) * math.exp(-low / (differ + 1))
        spare = math.ceil(empty + 3 * math.sqrt(empty))
        return differ + 1 + spare, spare


def keys(own: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: its blocks in its own band and in the one below."""
    found, band = [], bands.of(len(own))
    for at in (band, band - 1):
        if at < 0 or (at < band and -(-len(own) * bands.percent // 100) > bands.tops[at]):
            continue
        count, spare = bands.blocks(at)
        if not count:
            continue
        place = ((own >> np.uint64(11)) % np.uint64(count)).astype(np.int64)
        block, held = np.zeros(count, np.uint64), np.bincount(place, minlength=count)
        np.bitwise_xor.at(block, place, own)
        used = held > 0
        if count - used.sum() > spare:
            used[:] = True
        which = np.flatnonzero(used).astype(np.uint64)
        found.append(_mix(_mix(block[used]) + which * np.uint64(_ODD) + np.uint64(at << 40)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def parity_bits(own: np.ndarray) -> list[int]:
    """64 SKETCH bits, each the parity of the n-grams that hash to it, as SKETCH signed numbers."""
    size = 64 * SKETCH
    bits = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _digests(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                own = shingles(text, words)
                h1 = np.bitwise_xor.reduce(_mix(own + np.uint64(1))) if len(own) else np.uint64(0)
                h2 = np.add.reduce(_mix(own ^ np.uint64(_ODD))) if len(own) else np.uint64(0)
                rows.append((doc, len(own), int(h1.view(np.int64)), int(h2.view(np.int64)), *parity_bits(own)))
            frame = pd.DataFrame(rows, columns=["id", "n", "h1", "h2", *_BITS])
            yield frame.astype({"id": "Int64"})

    return docs.mapInPandas(run, ", ".join(f"{c} long" for c in ("id", "n", "h1", "h2", *_BITS)))


def _keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for batch in batches:
            found, ids, held = [], [], 0
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                own = keys(shingles(text, words), bands)
                found.append(own)
                ids.append(np.full(len(own), doc, np.int64))
                held += len(own)
                if held > 500_000:
                    yield pd.DataFrame({"key": np.concatenate(found).view(np.int64), "id": np.concatenate(ids)})
                    found, ids, held = [], [], 0
            if found:
                yield pd.DataFrame({"key": np.concatenate(found).view(np.int64), "id": np.concatenate(ids)})

    return docs.mapInPandas(run, "key long, id long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch[at:at + 500]
                own = [shingles(text, words).view(np.int64) for text in part["text"]]
                yield pd.DataFrame({"id": part["id"].astype(np.int64), "own": own})

    return docs.mapInPandas(run, "id long, own array<long>")


def similar(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links, itself included).

    Two rows link when 100 times the shared n-grams are at least `percent` times all n-grams.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    digests = materialize(_digests(docs, words))
    own = digests.where("n > 0 AND id IS NOT NULL")
    firsts = materialize(own.groupBy("n", "h1", "h2").agg(
        F.min("id").alias("first"), *[F.min(p).alias(p) for p in _BITS]))
    about = firsts.select(F.col("first").alias("id"), "n", *_BITS)
    named = docs.where("id IS NOT NULL")
    # one row of each set of equal texts goes on
    others = own.join(firsts.select(F.col("first").alias("id")), "id", "left_anti").select("id").distinct()
    keyed = by_ids(_keyed(named, words, percent), materialize(others), "left_anti")

    def close(a, b):
        low, high = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
        apart = sum(F.bit_count(a(p).bitwiseXOR(b(p))) for p in _BITS)
        # the symmetric difference is at most (a + b)(1 - t)/(1 + t)
        return (low * 100 >= high * percent) & (apart * (100 + percent) <= (low + high) * (100 - percent))

    def verify(pairs: DataFrame) -> DataFrame:
        met = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        sets = materialize(_sets(by_ids(named, met, "left_semi"), words))
        a = sets.select(F.col("id").alias("a"), F.col("own").alias("a_own"))
        b = sets.select(F.col("id").alias("b"), F.col("own").alias("b_own"))
        both = pairs.join(b, "b").join(a, "a").select(
            "a", "b", F.size("a_own").alias("_a"), F.size("b_own").alias("_b"),
            F.size(F.array_intersect("a_own", "b_own")).alias("_both"))
        return both.where(f"100 * _both >= {percent} * (_a + _b - _both)").select("a", "b").distinct()

    groups = components(link(keyed, about, close, verify))
    named_sets = firsts.join(groups, F.col("first") == F.col("id"), "left").select(
        "n", "h1", "h2", F.coalesce("component", "first").alias("component"))
    found = digests.join(named_sets, ["n", "h1", "h2"], "left")
    return found.select("id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.least("component", "id")).otherwise(F.col("id")).alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The documents without those linked to one with a smaller id. Of rows equal in id and text one
    stays; other texts under an id that stays, rows without words and rows with a null id all stay."""
    groups = similar(docs, words, percent, id_col, text)
    go = groups.where("id <> component_id").select("id").distinct()
    kept = docs.join(go, docs[id_col] == go["id"], "left_anti")
    # rows that repeat an id: only where there are any, and only those travel
    again = materialize(groups.where("n_shingles > 0 AND id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"))
    if again.isEmpty():
        return kept
    single = kept.join(again, kept[id_col] == again["id"], "left_anti")
    return single.union(kept.join(again, kept[id_col] == again["id"], "left_semi").dropDuplicates([id_col, text]))
