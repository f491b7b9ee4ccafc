"""A positional inverted index over training texts, and exact and near matches of test phrases in it.

Texts are lower-cased (A-Z only) and cut into words, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. The index is dealt
by blocks of documents: in a block all words stand in one sequence with a gap between documents, and a
posting list is a word's places in it. Lists are stored for the words that can matter: those whose checksum
is marked in a map of `MARKS` bits made from the phrases, so what every task gets has a fixed size, and a
test set of ever more words only makes more lists be stored. The lists are written to the shared folder.

A phrase is sought in the blocks that hold all its words: every word's places, less the word's offset, are
intersected from the block's rarest word on; what is left are exact places. Near matches are stretches of at
most `within` words of one document that hold all of a phrase's words in any order, each found from a
place of the rarest word. Phrases are sent to the blocks as numbers, `SLICE` at a time at most; more of them
mean more passes over the lists. 64-bit hashes tell a block's words apart.

Documents: a null or empty text has no words and matches nothing; null ids, equal ids and repeated rows are
documents of their own. A document of any length stays in one block, which may thus hold more than `BLOCK`
words. Test items: a null text or one without words has no phrases and matches nothing; rows of one id
count as one item; an item with a null id marks words but is named nowhere. Empty tables give no hits. Only
the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.lineage import materialize

#: Words of one block, but for a single longer document.
BLOCK = 1 << 20
#: Bits of the map of words the phrases use.
MARKS = 1 << 20
#: Phrases compared with the lists in one pass.
SLICE = 1 << 18
#: Copies of the table of phrases and items, so that a phrase many documents hold is shared among tasks.
SPREAD = 16

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes of UTF-8: letters A-Z lowered, all else that is no word byte a blank.
_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def phrases(items: DataFrame, length: int = 10, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """phrase_id, phrase (words joined by blanks), item, once each: all runs of `length` words of every item,
    or all words of a shorter one."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    read = items.select(F.col(id_col).alias("item"), found.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    every = F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))
    rows = materialize(read.where(F.size("w") > 0).select("item", F.explode(every).alias("phrase")).distinct())
    known = materialize(rows.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    return materialize(rows.join(known, "phrase"))


@dataclass(frozen=True)
class Index:
    """documents: block, place, id, n_words. lists: block, word, key (the word's hash), places (increasing);
    the word '' has the documents' starts."""

    documents: DataFrame
    lists: DataFrame


class _Marked(dict):
    """The number of a word in a block, -1 for words no phrase can hold."""

    def __init__(self, marks: np.ndarray):
        super().__init__()
        self.marks, self.known = marks, []

    def __missing__(self, word: bytes) -> int:
        n = -1
        if self.marks[zlib.crc32(word) % len(self.marks)]:
            n = len(self.known)
            self.known.append(word)
        self[word] = n
        return n


def posting_lists(
    texts: list[list[bytes]], starts: np.ndarray, marks: np.ndarray
) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The marked words, all places word after word, and where each word's places begin and end in them."""
    number = _Marked(marks)
    ids = np.fromiter((x for ws in texts for x in map(number.__getitem__, ws)), np.int32)
    sizes = np.array([len(ws) for ws in texts])
    places = np.arange(len(ids)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    kept = ids >= 0
    ids, places = ids[kept], places[kept]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(number.known)))])
    return number.known, places[np.argsort(ids, kind="stable")].astype(np.int32), bounds.astype(np.int32)


def build(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """The index of `docs` for the `wanted` phrases."""
    used = wanted.select(F.explode(F.split("phrase", " ")).alias("word")).select((F.crc32("word") % MARKS).alias("slot"))
    marks = np.zeros(MARKS, bool)
    marks[used.distinct().toPandas()["slot"].to_numpy(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(ws) for ws in texts], np.int32)
            starts = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
            key = (task << 32) + n

            def rows(m: int, **own: pa.Array) -> pa.RecordBatch:
                kinds = {"word": pa.string(), "key": pa.int64(), "places": pa.list_(pa.int32()), "place": pa.int32(),
                         "id": kind, "n_words": pa.int32()}
                columns = [own.get(c, pa.nulls(m, t)) for c, t in kinds.items()]
                return pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), *columns], ["block", *kinds])

            known, places, bounds = posting_lists(texts, starts, marks)
            yield rows(len(ids), place=pa.array(np.arange(len(ids), dtype=np.int32)), id=pa.array(ids, kind),
                       n_words=pa.array(lengths))
            hashed = np.array([0, *(xxhash.xxh64_intdigest(w, 42) for w in known)], np.uint64).view(np.int64)
            every = np.concatenate([starts, places])
            yield rows(len(known) + 1, word=pa.array(["", *(w.decode() for w in known)]), key=pa.array(hashed),
                       places=pa.ListArray.from_arrays(np.concatenate([[0], bounds + len(starts)]).astype(np.int32), every))

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(t.as_py())
                if texts and size + len(ws) > BLOCK:
                    yield from block(kind)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(ws)
                size += len(ws)
        if texts:
            yield from block(kind)

    read = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    made = materialize(read.mapInArrow(
        run, f"block long, word string, key long, places array<int>, place int, id {kind}, n_words int"))
    return Index(made.where("word IS NULL").select("block", "place", "id", "n_words"),
                 made.where("word IS NOT NULL").select("block", "word", "key", "places"))


def exact(lists: list[np.ndarray]) -> np.ndarray:
    """Where a phrase starts, given the places of each of its words: lists less their offsets,
    intersected from the shortest on."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        own = lists[k]
        starts = starts[own[np.minimum(np.searchsorted(own, starts + k), len(own) - 1)] == starts + k]
    return starts


def near(lists: list[np.ndarray], documents: np.ndarray, within: int) -> np.ndarray:
    """Ends of stretches of at most `within` words of one document that hold every word. `documents`: starts."""
    order = sorted(lists, key=len)
    rare = order[0]
    for own in order[1:]:
        # a place of the rarest word needs one of every other word closer than `within`
        before = own[np.maximum(np.searchsorted(own, rare, side="right") - 1, 0)]
        after = own[np.minimum(np.searchsorted(own, rare), len(own) - 1)]
        rare = rare[(np.abs(rare - before) < within) | (np.abs(after - rare) < within)]
        if not len(rare):
            return rare
    found = set()
    for at in rare.tolist():
        about = [own[np.searchsorted(own, at - within + 1):np.searchsorted(own, at + within)] for own in order]
        ends = np.unique(np.concatenate(about))
        first = ends
        for own in about:
            last = np.searchsorted(own, ends, side="right") - 1
            first = np.where(last < 0, at - 2 * within, np.minimum(first, own[np.maximum(last, 0)]))
        close = ends - first < within
        ends, first = ends[close], first[close]
        same = np.searchsorted(documents, ends, side="right") == np.searchsorted(documents, first, side="right")
        found.update(ends[same].tolist())
    return np.array(sorted(found), np.int64)


def _seeker(sent: Broadcast, within: int | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Finds the sent phrases (ids, sizes, a row of hashes each) in the lists of one block."""

    def run(block: tuple, postings: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, grid = sent.value
        order = np.argsort(postings["key"].to_numpy())
        known, lists = postings["key"].to_numpy()[order], postings["places"].to_numpy()[order]
        documents = lists[np.searchsorted(known, 0)]
        at = np.minimum(np.searchsorted(known, grid), len(known) - 1)
        rows = []
        for k in np.flatnonzero((known[at] == grid).all(1)).tolist():
            own = [lists[i] for i in at[k, :sizes[k]].tolist()]
            starts = exact(own)
            ends = near([lists[i] for i in set(at[k, :sizes[k]].tolist())], documents, within) if within else starts[:0]
            if not len(starts) and not len(ends):
                continue
            of, last = (np.searchsorted(documents, x, side="right") - 1 for x in (starts, ends))
            for d in np.union1d(of, last).tolist():
                rows.append((block[0], d, ids[k], sizes[k], (starts[of == d] - documents[d]).astype(np.int32),
                             (ends[last == d] - documents[d]).astype(np.int32)))
        return pd.DataFrame(rows, columns=["block", "place", "phrase_id", "n", "starts", "ends"])

    return run


def occurrences(index: Index, wanted: DataFrame, within: int | None = None) -> DataFrame:
    """block, place, phrase_id, n (words), starts: a document's places of a phrase, as word numbers from 0.
    With `within`, also ends, the last words of near matches; starts may then be empty."""
    keys = F.transform(F.split("phrase", " "), lambda w: F.xxhash64(w))
    sought = materialize(wanted.select("phrase_id", keys.alias("keys")).distinct())
    slices = max(1, -(-sought.count() // SLICE))
    schema = "block long, place int, phrase_id long, n int, starts array<int>, ends array<int>"
    out = None
    for s in range(slices):
        part = sought.where(F.pmod(F.xxhash64("phrase_id"), F.lit(slices)) == s).toPandas()
        sizes = part["keys"].map(len).to_numpy(np.int64)
        # a phrase's hashes stand in one row; the rest of a shorter one's row is 0, the key of ''
        grid = np.zeros((len(part), int(sizes.max(initial=1))), np.int64)
        if len(part):
            grid[np.arange(grid.shape[1]) < sizes[:, None]] = np.concatenate(part["keys"].to_numpy())
        sent = index.lists.sparkSession.sparkContext.broadcast((part["phrase_id"].to_numpy(), sizes, grid))
        found = index.lists.groupBy("block").applyInPandas(_seeker(sent, within), schema)
        out = found if out is None else out.unionByName(found)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _joined(places: pd.Series) -> pd.Series:
    """Word spans put together where they meet or overlap."""
    out = []
    for each in places:
        spans = sorted({(int(s), int(s) + int(p["n"])) for p in each for s in p["starts"]})
        joined = []
        for begin, end in spans:
            if joined and begin <= joined[-1]["end"]:
                joined[-1]["end"] = max(end, joined[-1]["end"])
            else:
                joined.append({"begin": begin, "end": end})
        out.append(joined)
    return pd.Series(out, dtype=object)


def contamination(
    docs: DataFrame, items: DataFrame, length: int = 10, within: int | None = 20,
    id_col: str = "doc_id", item_col: str = "item_id", text: str = "text",
) -> DataFrame:
    """Per document: id, n_words, spans (words inside phrases, begin to end exclusive), items (sorted as
    text, with a phrase in it) and near_items (with a near match, exact ones among them).

    A document's occurrences are at most ten times its words, so its group is as bounded as its text.
    """
    wanted = phrases(items, length, item_col, text)
    index = build(docs, wanted, id_col, text)
    found = materialize(occurrences(index, wanted, within))
    spans = found.where(F.size("starts") > 0).groupBy("block", "place").agg(
        F.collect_list(F.struct("n", "starts")).alias("_places"))
    spans = spans.select("block", "place", _joined("_places").alias("spans"))
    copies = wanted.where("item IS NOT NULL").select(
        "phrase_id", F.col("item").cast("string").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("share"))
    named = found.select("block", "place", "phrase_id", (F.size("starts") > 0).alias("exact"), (F.size("ends") > 0).alias("near"),
                         F.pmod(F.xxhash64("block", "place"), F.lit(SPREAD)).cast("int").alias("share"))
    hit = named.join(copies, ["phrase_id", "share"]).groupBy("block", "place", "item").agg(
        F.max("exact").alias("exact"), F.max("near").alias("near"))
    listed = hit.groupBy("block", "place").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.array_sort(F.collect_list(F.when(F.col("near"), F.col("item")))).alias("near_items"))
    none = F.array().cast("array<string>")
    return (
        index.documents.join(spans, ["block", "place"], "left").join(listed, ["block", "place"], "left")
        .select("id", F.col("n_words").cast("long").alias("n_words"),
                F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
                F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")))
