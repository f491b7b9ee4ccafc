"""Stretches of text that repeat with a period, found by a dictionary of basic factors.

The words of a text are numbered; then the stretches of 2, 4, 8, ... words are numbered from pairs of
shorter ones, as long as any stretch of that length occurs twice. Occurrences of one stretch that follow
each other within twice its length form arithmetic progressions, whose difference proposes a period. A
proposal is extended both ways with the numbered stretches, from the longest to single words, and equal
results are put together. A run is the widest stretch with smallest period q whose length is at least
`least` words and `times` times q.

Every run is found: the stretch of the smallest power of two not below q that starts where the run does
occurs again q words later, within the run as its length is 3q or more, and nowhere between, or q would not
be its smallest period. And a proposal's difference is the smallest period of what it extends to, if that
is three times as long, for the same reason.

A null or empty text has no words and no runs. Words are what `[^\\x20\\x09-\\x0D]+` matches. A text is
worked on whole: memory is some 4 bytes for each word and each length that still repeats. Rows are taken
one by one, so null ids, repeated rows and empty tables make no difference; of the input's columns only
`into` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words worked on at once; a longer text is taken by itself.
BLOCK = 1 << 18
_FOUND = "starts array<long>, lengths array<long>, periods array<long>, n_words long, collapsed string"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _factors(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each power of two that repeats: it, the number of the stretch at each place (-1: it occurs
    once), and where progressions of near occurrences start, with their difference."""
    n, size = len(keys), 1
    places, names = np.arange(n), None
    while len(places):
        order = np.argsort(keys, kind="stable")
        at, same = places[order], np.diff(keys[order]) == 0
        group = np.concatenate([[0], np.cumsum(~same)])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        names = np.full(n, -1, np.int32)
        names[at[twice]] = group[twice]
        gap = np.zeros(n + 1, np.int64)
        gap[at[:-1][same] + 1] = np.diff(at)[same]
        gap[gap > 2 * size] = 0
        head = np.flatnonzero((gap[1:] > 0) & (gap[1:] != gap[:-1]))
        yield size, names, head, gap[head + 1]
        places = np.flatnonzero(names >= 0)
        places = places[places + size < n]
        places = places[names[places + size] >= 0]
        keys = names[places].astype(np.int64) * (int(group[-1]) + 1) + names[places + size]
        size *= 2


def find_runs(keys: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of a sequence of numbers, by start and period."""
    n, levels, heads, gaps = len(keys), [], [], []
    for size, names, head, gap in _factors(keys):
        levels.append((size, names))
        heads.append(head)
        gaps.append(gap)
    if not levels:
        return (np.zeros(0, np.int64),) * 3
    at, gap = np.unique(np.stack([np.concatenate(heads), np.concatenate(gaps)]), axis=1)
    end, begin = at + gap, at.copy()
    for size, names in reversed(levels):
        here = names[np.minimum(end, n - 1)]
        more = (end < n) & (here >= 0) & (here == names[end - gap])
        end += size * more
        back = begin - size
        here = names[np.maximum(back, 0)]
        begin -= size * ((back >= 0) & (here >= 0) & (here == names[np.minimum(np.maximum(back, 0) + gap, n - 1)]))
    long = end - begin >= np.maximum(least, times * gap)
    begin, gap, end = np.unique(np.stack([begin[long], gap[long], end[long]]), axis=1)
    return begin, end - begin, gap


def _block(texts: list[list[bytes]], least: int, times: int) -> list[tuple]:
    sizes = np.array([len(words) for words in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    number = _Numbers()
    ids = np.fromiter((x for words in texts for x in map(number.__getitem__, words)), np.int64, bounds[-1])
    # words of unlike texts count as unlike, so no stretch across a border occurs twice
    start, length, period = find_runs(ids * len(texts) + np.repeat(np.arange(len(texts)), sizes), least, times)
    drops = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    dropped = np.cumsum(drops)[:-1] > 0
    cut = np.searchsorted(start, bounds)
    out = []
    for k, words in enumerate(texts):
        own = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            words = [words[i] for i in np.flatnonzero(~dropped[bounds[k]:bounds[k + 1]]).tolist()]
        out.append((start[own] - bounds[k], length[own], period[own], int(sizes[k]), b" ".join(words).decode()))
    return out


def found(text: Column, least: int = 24, times: int = 3) -> Column:
    """A struct: starts, lengths and periods of the runs (words from 0, by start and period), n_words, and
    collapsed: the words no run holds after its first period, joined by single blanks."""

    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        out, block, size = [], [], 0
        for value in texts:
            words = (value or "").encode().split()
            if block and size + len(words) > BLOCK:
                out += _block(block, least, times)
                block, size = [], 0
            block.append(words)
            size += len(words)
        out += _block(block, least, times) if block else []
        return pd.DataFrame(out, columns=["starts", "lengths", "periods", "n_words", "collapsed"])

    return run(text)


def collapse(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3, into: str = "periodic") -> DataFrame:
    """The rows with a struct column `into`: runs (start, length, period), n_words and collapsed."""
    read = docs.withColumn(into, found(F.col(text), least, times))
    runs = F.arrays_zip(F.col(f"{into}.starts").alias("start"), F.col(f"{into}.lengths").alias("length"),
                        F.col(f"{into}.periods").alias("period"))
    return read.withColumn(into, F.struct(
        runs.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"),
        F.col(f"{into}.n_words").alias("n_words"), F.col(f"{into}.collapsed").alias("collapsed")))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole fractions; ties: smallest start, then
    period, which is the runs' order. Null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def repeated_by_rule(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with periodic stretches written into a tenth of the texts, by a rule on the id's checksum.

    With h = crc32 of the decimal id and g = h // 10: where h % 10 = 0 and the text has n > 0 words, the
    words from a = g % n on repeat its next p = 1 + (n - a) // (3 + g % 8) words. Such texts have single
    blanks; a null id leaves its text alone.
    """
    names = docs.columns
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    some = docs.withColumns({"_gl_g": F.floor(h / 10), "_gl_w": F.when(h % 10 == 0, words)})
    n = F.size("_gl_w")
    some = some.withColumn("_gl_a", F.when(n > 0, (F.col("_gl_g") % n).cast("int")))
    some = some.withColumn("_gl_p", (1 + F.floor((n - F.col("_gl_a")) / (3 + F.col("_gl_g") % 8))).cast("int"))
    some = some.withColumn("_gl_c", F.slice("_gl_w", F.col("_gl_a") + 1, F.col("_gl_p")))
    left = n - F.col("_gl_a")
    written = F.concat(
        F.slice("_gl_w", F.lit(1), F.col("_gl_a")),
        F.flatten(F.array_repeat("_gl_c", F.floor(left / F.col("_gl_p")).cast("int"))),
        F.slice("_gl_c", F.lit(1), left % F.col("_gl_p")))
    return some.withColumn(text, F.when(F.col("_gl_a").isNotNull(), F.array_join(written, " ")).otherwise(F.col(text))).select(*names)
