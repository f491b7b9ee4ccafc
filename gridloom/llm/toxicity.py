"""Toxicity by a classifier chain: one linear model per category, each also given the earlier ones'
probabilities.

A text's features are its distinct words and their beginnings, hashed. The models are logistic
regressions fitted on labelled documents. So that a later model learns from probabilities like those
it will meet, the earlier categories' probabilities it is trained with are out-of-fold predictions.
The cut for the last category is the one with the best F1 score over its out-of-fold predictions.

Training reads a bounded sample: about `sample` labelled documents, chosen by a hash of the id
(Spark counts the labels first). Scoring reads every whole text of every row.

A null or empty text has no features and gets the models' base rates. Labels that are null, of
unknown documents or repeated with other values: null and unknown ones are left out, repeated ones
count as separate rows. Without any labelled document, or if all labels of a category are equal, its
probability is constant and nothing is toxic. Other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.lineage import materialize
from gridloom.llm.parity_join import _tables

BITS = 20
#: Bytes of a word's beginnings that are features of their own.
BEGINNINGS = (4, 6)
#: A feature has to occur in so many documents of the sample.
LEAST_DOCS = 4
FOLDS = 3
_OTHER = regex.compile(r"[\W_]+")
_PART = 1 << 18


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def features(text: str | None) -> np.ndarray:
    """The sorted feature numbers of a text."""
    data = _OTHER.sub(" ", (text or "").lower()).encode("utf-8", "replace") + b" "
    values, (powers, inverse) = _values(), _tables()[2:]
    found, at = [], 0
    while at < len(data):
        # whole words; a word longer than a part is cut
        stop = data.rfind(b" ", at, at + _PART) + 1
        part = np.frombuffer(data[at:stop if stop > at else at + _PART], np.uint8)
        at += len(part)
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = part != 32
        edge = np.diff(word)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers[:len(part)], out=sums[1:])
        for salt, size in enumerate((None, *BEGINNINGS)):
            a, b = begin, end
            if size:
                a = begin[end - begin > size]
                b = a + size
            h = (sums[b] - sums[a]) * inverse[a] + np.uint64(salt)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Rows:
    """Sparse binary rows beside dense columns."""

    index: np.ndarray
    row: np.ndarray
    dense: np.ndarray

    @staticmethod
    def of(lists: Sequence[np.ndarray], dense: np.ndarray) -> Rows:
        sizes = [len(x) for x in lists]
        flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.int32)
        return Rows(flat.astype(np.int64), np.repeat(np.arange(len(lists)), sizes), dense)

    def times(self, weights: np.ndarray, rest: np.ndarray) -> np.ndarray:
        n = len(self.dense)
        return np.bincount(self.row, weights[self.index], n) + self.dense @ rest[1:] + rest[0]

    def back(self, error: np.ndarray, width: int) -> np.ndarray:
        return np.concatenate([np.bincount(self.index, error[self.row], width), [error.sum()], self.dense.T @ error])


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(rows: Rows, y: np.ndarray, width: int, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by L-BFGS: weights, then the base and the dense columns' weights."""
    size = width + 1 + rows.dense.shape[1]
    shrink = np.full(size, penalty)
    shrink[width] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.times(w[:width], w[width:])
        cost = np.logaddexp(0, z) - y * z
        return cost.sum() + 0.5 * (shrink * w * w).sum(), rows.back(_chance(z) - y, width) + shrink * w

    w = np.zeros(size)
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        move, scales = slope.copy(), []
        for s, g in reversed(steps):
            scale = s @ move / (s @ g)
            scales.append(scale)
            move -= scale * g
        if steps:
            s, g = steps[-1]
            move *= (s @ g) / (g @ g)
        else:
            move /= max(1.0, np.abs(slope).max())
        for (s, g), scale in zip(steps, reversed(scales), strict=True):
            move += s * (scale - g @ move / (s @ g))
        length = 1.0
        for _ in range(20):
            new = w - length * move
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * length * (slope @ move):
                break
            length /= 2
        else:
            break
        if (new - w) @ (new_slope - slope) > 1e-12:
            steps = [*steps[-7:], (new - w, new_slope - slope)]
        done = value - new_value < 1e-6 * abs(value)
        w, value, slope = new, new_value, new_slope
        if done:
            break
    return w


@dataclass
class Chain:
    """The fitted models: feature numbers, their weights, base and dense weights per category."""

    categories: list[str]
    models: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    cut: float

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for index, weights, rest in self.models:
            table = np.zeros(1 << BITS, np.float32)
            table[index] = weights
            out.append((table, rest))
        return out


def _fit(group: pd.DataFrame, category: str, earlier: list[str]) -> pd.DataFrame:
    """Out-of-fold probabilities for a fold, or the model of all rows (fit = FOLDS)."""
    fold = int(group["fit"].iloc[0])
    group = group.sort_values(["id", "feats_hash"])
    dense = group[earlier].to_numpy(float) if earlier else np.zeros((len(group), 0))
    y, lists = group[category].to_numpy(float), list(group["feats"])
    train = (group["fold"] != fold).to_numpy()
    known = np.concatenate([lists[k] for k in np.flatnonzero(train)] or [np.zeros(0, np.int32)])
    index = np.flatnonzero(np.bincount(known, minlength=1 << BITS) >= LEAST_DOCS)
    place = np.full(1 << BITS, -1)
    place[index] = np.arange(len(index))
    lists = [(p := place[x])[p >= 0] for x in lists]
    chosen = [lists[k] for k in np.flatnonzero(train)]
    if len(set(y[train])) < 2:
        rate = y[train].mean() if train.any() else 0.0
        w = np.zeros(len(index) + 1 + len(earlier))
        w[len(index)] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
    else:
        w = fit_linear(Rows.of(chosen, dense[train]), y[train], len(index))
    if fold == FOLDS:
        return pd.DataFrame({"fit": [fold], "id": [0], "fold": [0], "prob": [0.0], "index": [index.astype("<i4").tobytes()],
                             "weights": [w[:len(index)].astype("<f4").tobytes()], "rest": [w[len(index):].astype("<f8").tobytes()]})
    out = Rows.of([lists[k] for k in np.flatnonzero(~train)], dense[~train])
    prob = _chance(out.times(w[:len(index)], w[len(index):]))
    return pd.DataFrame({"fit": fold, "id": group["id"].to_numpy()[~train], "fold": fold, "prob": prob,
                         "index": None, "weights": None, "rest": None})


def _best_cut(prob: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling a row positive has the best F1 score."""
    if not y.any():
        return 2.0
    order = np.argsort(-prob, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    below = prob[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((prob[order[best]] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = 8192,
        id_col: str = "doc_id", text: str = "text") -> Chain:
    """Models for the categories in this order. labels: the id and a 0/1 column per category.

    What comes to the driver is the models (at most 2^20 weights each) and the sample's probabilities.
    """
    categories = list(categories)
    known = labels.where(F.col(id_col).isNotNull()).dropna(subset=categories)
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where((F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))).select(
        F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in categories])
    # about `sample` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    rows = materialize(rows.select(
        "id", *categories, find("text").alias("feats"), F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")))
    rows = rows.withColumn("feats_hash", F.xxhash64("feats"))
    models, cut, earlier = [], 2.0, []
    for category in categories:
        copies = rows.withColumn("fit", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))))
        schema = "fit int, id long, fold int, prob double, index binary, weights binary, rest binary"

        def one(group: pd.DataFrame, category: str = category, earlier: tuple[str, ...] = tuple(earlier)) -> pd.DataFrame:
            return _fit(group, category, list(earlier))

        found = materialize(copies.groupBy("fit").applyInPandas(lambda group: one(group), schema))  # noqa: B023
        model = found.where(F.col("fit") == FOLDS).first()
        if model is None:
            models.append((np.zeros(0, np.int32), np.zeros(0, np.float32), np.array([-30.0] + [0.0] * len(earlier))))
            earlier.append(f"_p{len(earlier)}")
            continue
        models.append((np.frombuffer(model["index"], "<i4"), np.frombuffer(model["weights"], "<f4"), np.frombuffer(model["rest"], "<f8")))
        name = f"_p{len(earlier)}"
        earlier.append(name)
        guesses = found.where(F.col("fit") < FOLDS).groupBy("id").agg(F.first("prob").alias(name))
        rows = rows.join(guesses, "id")
        if category == categories[-1]:
            seen = rows.select(name, category).toPandas()
            cut = _best_cut(seen[name].to_numpy(), seen[category].to_numpy())
    return Chain(categories, models, cut)


def score(docs: DataFrame, chain: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """The rows with a struct of the probability of each category (p_<category>) and toxic, whether the
    last one reaches the cut."""
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories]
    schema = T.StructType([*fields, T.StructField("toxic", T.BooleanType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = chain.tables()
        for batch in batches:
            out = np.zeros((len(batch), len(tables)))
            for k, own in enumerate(map(features, batch)):
                for c, (table, rest) in enumerate(tables):
                    z = float(table[own].sum(dtype=np.float64)) + rest[0] + out[k, :c] @ rest[1:]
                    out[k, c] = _chance(np.array(z))
            frame = pd.DataFrame(out, columns=[f.name for f in fields])
            frame["toxic"] = frame[fields[-1].name] >= chain.cut
            yield frame

    return docs.withColumn(into, run(F.col(text)))
