"""Links between things found through shared keys, and the groups they form, without all pairs.

Two things can only be alike if they share a key (a bucket). First every member of a bucket is
compared with its smallest member only. The links found group most of a bucket; only members of one
bucket that stand in different groups are then compared with each other, so a bucket of thousands of
copies costs a comparison each, and no link that matters to the groups is missed. They too meet the
smallest few members first, then more in growing steps: whoever joined a group meets none of it any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.lineage import materialize

#: Id lists up to this length are sent to every executor (about 16 bytes each); longer ones are joined.
SENT_IDS = 1_000_000
#: how fast the part of a bucket grows that all its other members meet
GROWTH = 32


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a stored list of ids (one column, of the same name), which is counted first."""
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, ids.columns[0], how)


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id that links (columns a, b) lead to, for all ids with links.

    Every round hangs larger ids under the smallest neighbour; a hub with many links is one row on
    one side of a join, whose other side Spark can split. The rounds grow with the logarithm of a
    chain's length, and each is written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(rest.union(root.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def link(keyed: DataFrame, about: DataFrame, close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
         verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (a, b) that make the same groups as all links between ids sharing a key.

    keyed: key, id; an id at most once per key. about: id and small columns. close: whether two ids
    may be alike, from those columns (called with two functions from a column's name to the column).
    verify: keeps of pairs a, b those that are alike.
    """
    bucket = Window.partitionBy("key")
    shared = keyed.withColumns({"first": F.min("id").over(bucket), "_last": F.max("id").over(bucket)})
    shared = materialize(shared.where("first < _last").select("key", "id", "first"))
    left = about.select([F.col(c).alias(f"a_{c}") for c in about.columns])
    right = about.select([F.col(c).alias(f"b_{c}") for c in about.columns])
    may = close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))

    pairs = shared.where("first < id").select(F.col("first").alias("a_id"), F.col("id").alias("b_id")).distinct()
    pairs = materialize(pairs.join(left, "a_id").join(right, "b_id").where(may)
                        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    links = materialize(verify(pairs))

    if shared.isEmpty():
        return links
    # the first has met all others, so a bucket of two is done, and one whose others stand in one group
    groups = components(links)
    rows = _still_open(shared.where("first < id").select("key", "id").join(about, "id"), groups, bucket)
    rows = materialize(rows.withColumn("rank", F.row_number().over(bucket.orderBy("id"))))
    largest, done, size = rows.agg(F.max("rank")).first()[0] or 0, 0, GROWTH
    while done < largest:
        a = rows.where((F.col("rank") > done) & (F.col("rank") <= size)).drop("rank")
        a = a.select("key", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "key"])
        b = rows.where(F.col("rank") > done).drop("rank")
        b = b.select("key", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "key"])
        more = a.join(b, (a["key"] == b["key"]) & (F.col("a_id") < F.col("b_id"))
                      & (F.col("a_component") != F.col("b_component")) & may)
        more = more.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            found = materialize(verify(more))
            links, pairs = links.union(found), pairs.union(more)
            groups = components(groups.toDF("a", "b").union(found)) if size < largest else groups
        done, size = size, size * GROWTH
        if done < largest:
            # members of smaller buckets have all met each other
            crowded = rows.where(F.col("rank") > done).select("key").distinct()
            rows = rows.drop("component").join(crowded, "key", "left_semi")
            rows = materialize(_still_open(rows, groups, bucket))
            largest = rows.agg(F.max("rank")).first()[0] or 0
    return links


def _still_open(rows: DataFrame, groups: DataFrame, bucket: WindowSpec) -> DataFrame:
    """The rows (key, id and others) of buckets whose members stand in several groups, with the member's group."""
    groups = groups.withColumnRenamed("id", "_id")
    rows = rows.join(groups, F.col("id") == F.col("_id"), "left").drop("_id").withColumn(
        "component", F.coalesce("component", "id"))
    rows = rows.withColumns({"_low": F.min("component").over(bucket), "_high": F.max("component").over(bucket)})
    return rows.where("_low < _high").drop("_low", "_high")
