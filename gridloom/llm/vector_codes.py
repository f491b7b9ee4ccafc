"""Compression of vectors to one small code per part, in whole numbers throughout.

Components become floor(scale * x). A vector is cut into equal parts; each part position has a codebook,
fitted in rounds: every part goes to its nearest entry, then an entry becomes the floored mean of its parts.

Nearest entries are found after an integer Walsh-Hadamard transform of the zero-padded parts and entries.
The transform multiplies every squared distance by the padded length, so sums of squared differences of the
first coefficients, taken in sequency order, are lower bounds of that multiple. One entry's whole distance
bounds the rest: entries above it go, step by step, and what is left has its exact distance. Ties go to the
lower index.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of unlike lengths
count as padded with zeros to the longest, rounded up to whole parts; an empty one is all zeros.
Components are held within `Shape.most`, beyond which 64 bits could not hold a distance (about 33 million,
or 32,000 before scaling, for 64 components). Starting entries are the smallest ids, null ids last, equal
ids by their vectors; fewer rows give fewer entries. Repeated rows are coded alike, each by itself. An
empty table gives no rows. Other columns are not read. Error sums beyond a long are null.

What the driver holds is bounded: the codebooks, `entries` times the length of a vector, and as many sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import materialize
from gridloom.operators import skew

#: Coefficients added between two eliminations.
STEP = 4
#: Vectors compared with a codebook at once.
BLOCK = 512


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: `parts` parts of `width` components."""

    parts: int
    width: int

    @property
    def padded(self) -> int:
        return 1 << (self.width - 1).bit_length()

    @property
    def most(self) -> int:
        """The largest component: all parts' multiplied distances together stay below 2^62."""
        return math.isqrt((1 << 60) // (self.padded * self.width * self.parts))


def sequency(n: int) -> np.ndarray:
    """The transform's rows, by their number of sign changes; n is a power of two."""
    row, bits = np.arange(n), n.bit_length() - 1
    turned = np.zeros(n, np.int64)
    for b in range(bits):
        turned |= ((row >> b) & 1) << (bits - 1 - b)
    for b in range(bits):
        turned ^= turned >> (1 << b) if (1 << b) < bits else 0
    return np.argsort(turned)


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, padded with zeros, in sequency order."""
    n, width = rows.shape
    size = 1 << (width - 1).bit_length()
    out = np.zeros((n, size), np.int64)
    out[:, :width] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of transformed rows, the nearest transformed entry and the distance times the padded length."""
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), BLOCK):
        part = rows[at:at + BLOCK]
        first = min(STEP, part.shape[1])
        sums = np.zeros((len(part), len(entries)), np.int64)
        for c in range(first):
            sums += (part[:, c, None] - entries[None, :, c]) ** 2
        guess = sums.argmin(1)
        bound = ((part - entries[guess]) ** 2).sum(1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left = sums[row, entry]
        for c in range(first, part.shape[1], STEP):
            left = left + ((part[row, c:c + STEP] - entries[entry, c:c + STEP]) ** 2).sum(1)
            stays = left <= bound[row]
            row, entry, left = row[stays], entry[stays], left[stays]
        order = np.lexsort((entry, left, row))
        best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        index[at:at + BLOCK], error[at:at + BLOCK] = entry[best], left[best]
    return index, error


@dataclass(frozen=True)
class Codebooks:
    shape: Shape
    #: part, entry, position
    entries: np.ndarray

    def transformed(self) -> list[np.ndarray]:
        return [transform(book) for book in self.entries]

    def digest(self) -> str:
        """SHA-256 of all components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(
    vectors: DataFrame, id_col: str, vector: str, label: str, parts: int, scale: int
) -> tuple[DataFrame, Shape]:
    """The kept rows as id, label, x (whole numbers, all of one length), as a stored table."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    shape = Shape(parts, max(1, -(-longest // parts)))
    low, high = F.lit(float(-shape.most)), F.lit(float(shape.most))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, low), high)).cast("int"))
    zeros = F.array_repeat(F.lit(0), F.lit(shape.parts * shape.width) - F.size("v"))
    return materialize(rows.select("id", "label", F.concat(whole, zeros).alias("x"))), shape


def _parts(rows: pd.Series, shape: Shape) -> list[np.ndarray]:
    stacked = np.stack(rows.to_numpy()).astype(np.int64).reshape(len(rows), shape.parts, shape.width)
    return [stacked[:, p] for p in range(shape.parts)]


def fit(rows: DataFrame, shape: Shape, entries: int, rounds: int) -> Codebooks:
    """Codebooks over all rows of `whole_numbers`."""
    start = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toPandas()["x"]
    if not len(start):
        return Codebooks(shape, np.zeros((shape.parts, 0, shape.width), np.int64))
    books = Codebooks(shape, np.stack(_parts(start, shape)))
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of its parts; unused ones stay."""
    shape, k = books.shape, books.entries.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((shape.parts, k, shape.width), np.int64), np.zeros((shape.parts, k), np.int64)
        ready = books.transformed()
        for batch in batches:
            for p, part in enumerate(_parts(batch["x"], shape) if len(batch) else []):
                index, _ = nearest(transform(part), ready[p])
                np.add.at(total[p], index, part)
                count[p] += np.bincount(index, minlength=k)
        p, e = np.nonzero(count)
        yield pd.DataFrame({
            "part": np.repeat(p, shape.width).astype(np.int32), "entry": np.repeat(e, shape.width).astype(np.int32),
            "position": np.tile(np.arange(shape.width, dtype=np.int32), len(p)),
            "total": total[p, e].ravel(), "n": np.repeat(count[p, e], shape.width)})

    each = rows.select("x").mapInPandas(sums, "part int, entry int, position int, total long, n long")
    found = each.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
    moved = books.entries.copy()
    place = tuple(found[c].to_numpy() for c in ("part", "entry", "position"))
    moved[place] = found["total"].to_numpy() // found["n"].to_numpy()
    return Codebooks(shape, moved)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, codes (an entry's index per part) and error, the squared distances summed."""
    shape = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = books.transformed()
        for batch in batches:
            if not len(batch):
                continue
            found = [nearest(transform(part), ready[p]) for p, part in enumerate(_parts(batch["x"], shape))]
            yield pd.DataFrame({
                "id": batch["id"], "label": batch["label"], "codes": list(np.stack([f[0] for f in found], 1).astype(np.int32)),
                "error": sum(f[1] for f in found) // shape.padded})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, Codebooks]:
    """Rows id, label, codes, error and label_error (errors of equal labels, nulls together), and the codebooks."""
    rows, shape = whole_numbers(vectors, id_col, vector, label, parts, scale)
    books = fit(rows, shape, entries, rounds)
    coded = materialize(encode(rows, books)).withColumn("_gl_key", F.struct("label"))
    sums = coded.groupBy("_gl_key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_gl_n"))
    out = skew.lookup(coded, sums, ("_gl_key",), ("label_error",), "_gl_n", (F.col("id"), F.col("codes")))
    return out.drop("_gl_key"), books
