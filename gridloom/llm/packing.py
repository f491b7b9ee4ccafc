"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A document is its token ids and an end id. Only documents longer than a sequence are cut. A piece
goes into the open sequence (or a new one) for which the sum over all fill levels of the squared
number of sequences open at that level becomes smallest; equal sums prefer the fullest sequence.

Pieces are dealt by a hash into groups of about GROUP_PIECES, so a group fits one task whatever the
input's size, and each group is packed by itself. A group leaves a few sequences part-filled.

Texts: None reads as empty; an empty text is the end id alone. Repeated rows are packed each for
itself; rows without an id as well. An empty table gives no rows. Columns other than the id and the
text are not read, so names can't clash.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gridloom.lineage import materialize
from gridloom.llm.bpe import _byte_letters
from gridloom.llm.pretokens import PieceCache, Splitter

#: Pieces packed together by one task.
GROUP_PIECES = 1 << 16


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> PieceCache:
    """The tokenizers library's ids, asked for once per distinct word and Python worker."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = Tokenizer.from_file(path).model
    letters = {b: c for c, b in _byte_letters().items()}
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}

    def encode(word: str) -> list[int]:
        spelled = word.encode("utf-8", "replace").decode("latin-1").translate(letters)
        return [t.id for t in model.tokenize(spelled)]

    return PieceCache(Splitter(False, list(specials)), list(specials.values()), encode)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: the id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    path: a vocabulary file with word ends, as the tokenizers library reads it.
    """
    fields = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _tokens(path)
        for batch in batches:
            rows = []
            for ids in tokens.ids(batch):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                own = []
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    piece = {"start": at, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes())}
                    own.append(piece | ({"ids": part.astype(np.int32)} if with_ids else {}))
                rows.append(own)
            yield pd.Series(rows, dtype=object)

    cut_docs = docs.select(F.col(id_col), F.posexplode(cut(F.col(text))).alias("piece", "_cut"))
    return cut_docs.select(id_col, "piece", "_cut.*")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        new_change = 2 * int(count[size]) + 1 if size < capacity else 0
        level = 0
        if size < capacity:
            # changes of the sum for levels capacity - size down to 1; a full sequence counts no more
            before = count[capacity - size:0:-1]
            change = np.where(before > 0, 2 * (count[capacity:size:-1] - before) + 2, 1 << 40)
            if before[0]:
                change[0] = 1 - 2 * before[0]
            best = int(change.argmin())
            if change[best] <= new_change:
                level = capacity - size - best
        if level:
            count[level] -= 1
            number[k] = open_at[level].pop()
        else:
            number[k] = made
            made += 1
        offset[k] = level
        level += size
        if level < capacity:
            count[level] += 1
            open_at[level].append(int(number[k]))
    return number, offset


def pack(cut_pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. sequence_id: the group above bit 40, a number below."""
    cut_pieces = materialize(cut_pieces)
    groups = max(1, -(-cut_pieces.count() // GROUP_PIECES))
    dealt = cut_pieces.withColumn("_order", F.xxhash64(id_col, "piece", "ids_crc32")).withColumn(
        "_group", F.expr(f"pmod(_order, {groups}L)"))
    schema = T.StructType([*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # in the hash's order: well mixed, and the same after a lost task
        group = group.sort_values(["_order", id_col, "piece"])
        number, offset = place(group["length"].to_numpy(), capacity)
        group = group.assign(sequence_id=(int(group["_group"].iloc[0]) << 40) + number, offset=offset)
        return group[schema.names]

    return dealt.groupBy("_group").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids it holds, from pieces packed with their ids. A list is as long as a
    sequence at most."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return rows.select("sequence_id", F.flatten("_parts.ids").alias("ids"))
