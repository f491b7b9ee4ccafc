"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: keys with fewer rows than this never count as hot
HOT_ROWS = 200_000
#: hot keys sent to every executor. With the keys ranked by row count, a key outside the
#: first N holds less than 1/(N+1) of all rows, so what stays in the shuffle is balanced.
HOT_KEYS = 1_000


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    take: Sequence[str],
    weight: str,
    spread_by: Sequence[Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Left join `rows` to `table` (unique on `on`), adding the columns `take`.

    `weight` is the table's count of rows per key. The few heaviest keys are answered from a
    broadcast of at most HOT_KEYS table rows; those rows, and rows with a null key, then enter
    the shuffle join under a hash of `spread_by` instead of their key, so no task receives a
    whole heavy key.
    """
    hot = (
        table.filter(F.col(weight) > (HOT_ROWS if hot_rows is None else hot_rows))
        .orderBy(F.col(weight).desc(), *[F.col(k) for k in on])
        .limit(HOT_KEYS)
        .select(*[F.col(k).alias(f"_h_{k}") for k in on],
                F.struct(*[F.col(t) for t in take]).alias("_hot"))
    )
    same = [F.col(k) == F.col(f"_h_{k}") for k in on]
    tagged = rows.join(F.broadcast(hot), _all(same), "left").drop(*[f"_h_{k}" for k in on])
    absent = F.lit(False)
    for k in on:
        absent = absent | F.col(k).isNull()
    # The place in the shuffle is a join key of its own. A constant salt would not do: the
    # optimizer turns it into a filter and shuffles by the bare key again.
    place = F.when(F.col("_hot").isNotNull() | absent, F.xxhash64(*spread_by)).otherwise(
        F.xxhash64(*on)
    )
    cold = table.select(
        *[F.col(k).alias(f"_c_{k}") for k in on],
        F.xxhash64(*on).alias("_c_place"),
        F.struct(*[F.col(t) for t in take]).alias("_cold"),
    )
    match = [F.col("_place") == F.col("_c_place")] + [F.col(k) == F.col(f"_c_{k}") for k in on]
    joined = tagged.withColumn("_place", place).join(cold, _all(match), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[F.col(c) for c in rows.columns],
                         *[found.getField(t).alias(t) for t in take])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def weighted(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """The part of `table` that `rows` refer to, with the number of referring rows per key."""
    known = rows
    for k in on:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*on).agg(F.count("*").alias("n_refs")).join(table, list(on), "inner")


#: an id list up to this length is sent to every executor
LIST_ROWS = 100_000


def without(rows: DataFrame, ids: DataFrame, on: str, keep: bool = False) -> DataFrame:
    """Rows whose `on` is not (with `keep`: is) among `ids`, a frame with the one column `on`.

    The list is counted up to LIST_ROWS; a short one is broadcast, a long one is looked up with
    its row counts so that a heavy id does not end in one task.
    """
    ids = ids.select(on).distinct()
    if ids.limit(LIST_ROWS + 1).count() <= LIST_ROWS:
        return rows.join(F.broadcast(ids), on, "left_semi" if keep else "left_anti")
    table = weighted(rows, ids.withColumn("_listed", F.lit(True)), (on,))
    spread = (F.struct(*[F.col(c) for c in rows.columns]),)
    marked = lookup(rows, table, (on,), ("_listed",), "n_refs", spread)
    kept = F.col("_listed").isNotNull() if keep else F.col("_listed").isNull()
    return marked.filter(kept).drop("_listed")
