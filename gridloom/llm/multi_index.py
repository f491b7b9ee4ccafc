"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and a vector lies in the cell
of its two nearest codewords. Around every vector the cells are visited in order of their distance
(the sum of the halves' squared distances, a multi-sequence order). How many cells are visited is
set on the codebooks' sample: so many that of vectors at exactly the threshold's angle the share
`recall` lies in a visited cell. Every vector met there is verified by cosine in double precision.
A link counts if either of its two vectors visits the other's cell.

Only vectors with equal labels and equal lengths are compared. Vectors that are null, zero, or hold a
null or a number that isn't finite, and vectors without a label, link with nothing: n_links 0, a
component of their own. Equal vectors are put together first and link with each other. A null id
links like others but names no component; rows that repeat an id count as separate vectors. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import materialize
from gridloom.llm.graph import components

#: Vectors the codebooks are fitted on, at most about; chosen by a hash.
SAMPLE = 16_384
#: Rows of a cell that meet in one block, each way.
BLOCK = 1024
_ROUNDS = 10


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances to all codewords."""
    return np.maximum((points * points).sum(1)[:, None] - 2 * points @ words.T + (words * words).sum(1), 0)


def _codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means; an empty codeword moves to the point farthest from its own."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    words = points[np.random.default_rng(seed).permutation(len(points))[:size]]
    for _ in range(_ROUNDS):
        far = _nearest(points, words)
        own = far.argmin(1)
        held = np.bincount(own, minlength=len(words))
        words = np.stack([np.bincount(own, points[:, k], len(words)) for k in range(points.shape[1])], 1) / np.maximum(held, 1)[:, None]
        lost = np.flatnonzero(held == 0)
        words[lost] = points[np.argsort(-far.min(1))[:len(lost)]]
    return words


@dataclass
class Index:
    """Two codebooks and the number of cells to visit."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, units: np.ndarray) -> np.ndarray:
        """Of every cell, by row; cell = first word * number of second words + second word."""
        half = self.first.shape[1]
        one, two = _nearest(units[:, :half], self.first), _nearest(units[:, half:], self.second)
        return (one[:, :, None] + two[:, None, :]).reshape(len(units), -1)

    def visited(self, units: np.ndarray) -> np.ndarray:
        """The cells each vector visits, nearest first; the first one is its own.

        The nearest `visits` sums of two sorted lists a, b use the i-th of a and the j-th of b only
        where (i + 1)(j + 1) <= visits, so only those pairs are put in order.
        """
        half, n = self.first.shape[1], self.visits
        one, two = _nearest(units[:, :half], self.first), _nearest(units[:, half:], self.second)
        by_one, by_two = np.argsort(one, 1, kind="stable")[:, :n], np.argsort(two, 1, kind="stable")[:, :n]
        pairs = [(i, j) for i in range(by_one.shape[1]) for j in range(by_two.shape[1]) if (i + 1) * (j + 1) <= n]
        i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        total = np.take_along_axis(one, by_one, 1)[:, i] + np.take_along_axis(two, by_two, 1)[:, j]
        order = np.argsort(total, 1, kind="stable")[:, :n]
        cells = by_one[:, i] * len(self.second) + by_two[:, j]
        return np.take_along_axis(cells, order, 1)


def fit_index(units: np.ndarray, count: int, threshold: float, recall: float) -> Index:
    """From a sample of unit vectors. count: how many vectors the index will hold."""
    size = max(4, min(256, round((count / 256) ** 0.5), len(units)))
    half = units.shape[1] // 2
    index = Index(_codebook(units[:, :half], size, 1), _codebook(units[:, half:], size, 2), 1)
    some = units[:2048]
    noise = np.random.default_rng(3).normal(size=some.shape)
    noise -= (noise * some).sum(1)[:, None] * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    partner = threshold * some + (1 - threshold**2) ** 0.5 * noise
    cell = index.distances(partner).argmin(1)
    away = index.distances(some)
    rank = (away < away[np.arange(len(some)), cell][:, None]).sum(1)
    index.visits = int(np.quantile(rank, recall, method="higher")) + 1
    return index


def _units(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(x, dtype=np.float64) for x in column])
    rows = rows / np.abs(rows).max(1)[:, None]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _meet(here: pd.DataFrame, there: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between visitors (there) and the rows of a cell (here): for each vector the number found,
    counted once, and a star of the group it belongs to in this block."""
    a, b = np.stack(there["unit"]), np.stack(here["unit"])
    close = a @ b.T >= threshold
    ids_a, ids_b = there["id"].to_numpy(), here["id"].to_numpy()
    close &= ids_a[:, None] != ids_b[None, :]
    # a visitor counts all it finds; a visited one only those whose own cells it doesn't visit
    unseen = ~np.stack([np.isin(there["own_cell"].to_numpy(), visits) for visits in here["visits"]], 1)
    found = [(ids_a, close @ here["n"].to_numpy()), (ids_b, (close & unseen).T @ there["n"].to_numpy())]
    low_a = np.where(close.any(1), ids_a, np.iinfo(np.int64).max)
    low_b = np.where(close.any(0), ids_b, np.iinfo(np.int64).max)
    while True:  # smallest id of each group
        new_a = np.minimum(low_a, np.where(close, low_b[None, :], np.iinfo(np.int64).max).min(1))
        new_b = np.minimum(low_b, np.where(close, new_a[:, None], np.iinfo(np.int64).max).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    frames = [pd.DataFrame({"id": ids, "links": links, "low": low}) for (ids, links), low in zip(found, (low_a, low_b), strict=True)]
    out = pd.concat(frames)
    out = out[(out["links"] > 0) | (out["low"] < np.iinfo(np.int64).max)]
    return out.assign(low=out["low"].where(out["low"] < out["id"], out["id"]))


def near_vectors(rows: DataFrame, threshold: float = 0.98, recall: float = 0.99, id_col: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, n_links (other vectors linked directly) and component_id (smallest id reachable), a row each."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull()
              & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0))
    key = F.when(F.coalesce(usable, F.lit(False)), F.struct(
        F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2")))
    named = materialize(rows.withColumn("key", key))
    # every distinct vector once, under a number of its own: ids may be null or repeated
    distinct = named.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.min("label").alias("label"), F.first("vector").alias("vector"))
    distinct = materialize(distinct.select("*", F.col("key.h1").alias("id"), F.size("vector").alias("size")))
    sizes = [r["size"] for r in distinct.groupBy("size").count().orderBy("size").collect()]  # one row per length
    found = None
    for size in sizes:
        own = _links(distinct.where(F.col("size") == size), threshold, recall)
        found = own if found is None else found.union(own)
    if found is None:
        return named.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = materialize(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "_id")
    whole = distinct.join(links, "id", "left").join(groups, F.col("id") == F.col("_id"), "left").select(
        "key", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    lowest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = whole.join(lowest, "component").select("key", "n_links", "component_id")
    return named.join(whole, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _links(distinct: DataFrame, threshold: float, recall: float) -> DataFrame:
    count = distinct.count()
    share = min(1.0, SAMPLE / count)
    sample = distinct.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector")
    index = fit_index(_units(sample.toPandas()["vector"]), count, threshold, recall)  # about SAMPLE rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                units = _units(part["vector"])
                cells = index.visited(units)
                yield pd.DataFrame({"id": part["id"], "n": part["n"], "label": part["label"], "unit": list(units),
                                    "own_cell": cells[:, 0], "visits": list(cells)})

    label = distinct.schema["label"].dataType.simpleString()
    placed = materialize(distinct.select("id", "n", "label", "vector").mapInPandas(
        place, f"id long, n long, label {label}, unit array<double>, own_cell long, visits array<long>"))
    lie = placed.groupBy("label", F.col("own_cell").alias("cell")).agg(F.count("*").alias("_lie"))
    come = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("_come"))
    # a crowded cell is cut into blocks, each way
    cut = lie.join(come, ["label", "cell"]).select(
        "label", "cell", F.ceil(F.col("_lie") / BLOCK).alias("_rows"), F.ceil(F.col("_come") / BLOCK).alias("_cols"))
    here = placed.withColumn("cell", F.col("own_cell")).join(cut, ["label", "cell"]).select(
        "label", "cell", "id", "n", "unit", "visits", F.pmod(F.xxhash64("id"), "_rows").alias("row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1)).alias("col"))
    there = placed.withColumn("cell", F.explode("visits")).join(cut, ["label", "cell"]).select(
        "label", "cell", "id", "n", "unit", "own_cell", F.pmod(F.xxhash64("id"), "_cols").alias("col"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("row"))

    there = there.select([F.col(c).alias(c) for c in there.columns])  # columns of its own for the cogroup

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "low": pd.Series(dtype="int64")})
        return _meet(a, b, threshold)

    block = ["label", "cell", "row", "col"]
    return here.groupBy(*block).cogroup(there.groupBy(*block)).applyInPandas(meet, "id long, links long, low long")
