"""Removal of passages that occur before, by hashes of runs of consecutive sentences.

A sentence starts after `.`, `!` or `?` and a blank, after a line end, or with a capital letter, as
passages get pasted in the middle of sentences. Runs: from every sentence on, and back from every sentence, as many
consecutive sentences as hold `run_words` words. Runs are hashed as lower-case words and joined over
all documents; a run's first place (smallest id, then place) stays, and all sentences covered by any
other place of it are marked. A passage of twice `run_words` words is therefore found whole.

A null text has no sentences; texts with fewer words than a run are never marked. Rows with a null id
come last in the order. Rows equal in id and text are one document. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.lineage import materialize
from gridloom.llm.fuzzy_lines import _ROW, _keyed
from gridloom.llm.parity_join import _mix
from gridloom.llm.pretokens import _powers, _values

_SPACE, _CAPITAL, _END, _SPOKEN = 1, 2, 4, 8


@functools.cache
def _marks() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it marks, and the lower-case letter it is hashed as."""
    every = [chr(c) for c in range(0x110000)]
    marks = np.array([_SPACE * c.isspace() + _CAPITAL * c.isupper() + _SPOKEN * c.isalnum() for c in every], np.uint8)
    marks[[ord(c) for c in ".!?"]] |= _END
    low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.int64)
    return marks, low


def runs(text: str, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (code points) of every run."""
    none = np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    marks, low = _marks()
    kind = marks[codes]
    word = np.zeros(len(codes) + 2, np.int8)
    word[1:-1] = (kind & _SPACE) == 0
    edge = np.diff(word)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin) < run_words:
        return none, none, none
    # words of letters and digits alone; marks between count nothing
    spoken = (kind & _SPOKEN) > 0
    at = np.concatenate([[0], np.cumsum(spoken)])
    letters = low[codes[spoken]]
    powers, inverse = _powers(1 << max(20, int(len(codes)).bit_length()))
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_values()[letters] * powers[:len(letters)], out=sums[1:])
    first, last = at[begin], at[end]
    heard = last > first
    words = _mix((sums[last[heard]] - sums[first[heard]]) * inverse[first[heard]])
    # a sentence starts after an end mark, after a line end, or with a capital letter
    lines = np.concatenate([[0], np.cumsum(codes == 10)])
    starts = np.ones(len(begin), bool)
    starts[1:] = ((kind[end[:-1] - 1] & _END) > 0) | (lines[begin[1:]] > lines[end[:-1]]) | ((kind[begin[1:]] & _CAPITAL) > 0)
    border = np.append(begin[starts], len(codes))
    border[0] = 0
    counts = np.concatenate([[0], np.cumsum(heard)])[np.append(np.flatnonzero(starts), len(begin))]
    own = np.flatnonzero(np.diff(counts))
    size = len(border)
    ahead = np.searchsorted(counts, counts[own] + run_words)
    behind = np.searchsorted(counts, counts[own + 1] - run_words, side="right") - 1
    pairs = np.unique(np.concatenate([(own * size + ahead)[ahead < size], (behind * size + own + 1)[behind >= 0]]))
    a, b = pairs // size, pairs % size
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:len(words)], out=sums[1:])
    h = _mix((sums[counts[b]] - sums[counts[a]]) * inverse[counts[a]] + (counts[b] - counts[a]).astype(np.uint64))
    return h.view(np.int64), border[a], border[b]


def repeated_spans(docs: DataFrame, run_words: int = 25, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans that repeat an earlier passage: _gl_row, span_begin, span_end (code points, end exclusive,
    overlapping ones joined) and first_ids, the documents whose passages they repeat."""
    bare = _keyed(docs, text, id_col).select(f"{_ROW}.id", f"{_ROW}.h", F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                found = [runs(text or "", run_words) for text in part["text"]]
                sizes = [len(x[0]) for x in found]
                run_hash, begin, end = (np.concatenate([x[k] for x in found]) for k in range(3))
                yield pd.DataFrame({
                    "id": np.repeat(part["id"].to_numpy(), sizes), "h": np.repeat(part["h"].to_numpy(), sizes),
                    "run": run_hash, "begin": begin.astype(np.int32), "end": end.astype(np.int32)})

    every = materialize(bare.mapInPandas(run, "id long, h long, run long, begin int, end int"))
    place = F.struct("id", "h", "begin")
    first = every.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    again = every.join(first.select("run", "first"), "run").where(place > F.col("first"))
    again = again.select("id", "h", "begin", "end", F.col("first.id").alias("first_id")).distinct()
    order = Window.partitionBy("id", "h").orderBy("begin", "end", "first_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = again.withColumn("_new", F.when(reach >= F.col("begin"), 0).otherwise(1)).withColumn(
        "_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("id", "h", "_span").agg(
        F.min("begin").alias("span_begin"), F.max("end").alias("span_end"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"),
    ).select(F.struct("id", "h").alias(_ROW), "span_begin", "span_end", "first_ids")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, spans, strict=True):
        for span in [] if gone is None else sorted(gone, key=lambda s: -s["span_begin"]):
            text = text[:span["span_begin"]] + text[span["span_end"]:]
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, run_words: int = 25, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without the sentences that repeat an earlier passage."""
    spans = repeated_spans(docs, run_words, id_col, text).groupBy(_ROW).agg(
        F.collect_list(F.struct("span_begin", "span_end")).alias("_gl_spans"))
    rows = _keyed(docs, text, id_col).join(spans, _ROW, "left")
    left = F.when(F.col("_gl_spans").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("_gl_spans")))
    return rows.withColumn(text, left).select(*docs.columns)
