"""Exact duplicates: rows that share an e-mail or code with an earlier row of their batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import skew

#: e-mail is tried before code
KEY_KINDS = ("email", "code")


def first_holders(records: DataFrame) -> DataFrame:
    """Earliest row of every e-mail and code that occurs more than once.

    One hash aggregation over both key kinds; the aggregate is two longs, so it combines map
    side and a key held by a third of the rows reaches the reducer as a few partial rows.
    """
    keys = F.array_compact(F.array(*[
        F.when(F.col(f"key_{kind}").isNotNull(),
               F.struct(F.lit(kind).alias("kind"), F.col(f"key_{kind}").alias("key")))
        for kind in KEY_KINDS
    ]))
    return (
        records.select("batch_id", "entity_type", "row_ord", F.inline(keys).alias("_kind", "_key"))
        .groupBy("batch_id", "entity_type", "_kind", "_key")
        .agg(F.min("row_ord").alias("first_ord"), F.count("*").alias("holders"))
        .filter("holders > 1")
    )


def annotate(records: DataFrame, one_key: bool = False) -> DataFrame:
    """Every row with exact_kind and exact_peer_ord, null when no earlier row shares a key.

    Rows with both an e-mail and a code take a second look-up, for the code, when the e-mail
    explained nothing. No entity type derives both; `one_key` says the rows are of that origin
    and leaves the second look-up out.
    """
    firsts = first_holders(records)
    both = F.col("key_email").isNotNull() & F.col("key_code").isNotNull()
    kind = F.when(F.col("key_email").isNotNull(), "email").when(F.col("key_code").isNotNull(), "code")

    def ask(rows: DataFrame, kind: Column, key: Column) -> DataFrame:
        asked = rows.withColumns({"_kind": kind, "_key": key})
        found = skew.lookup(
            asked, firsts, on=("batch_id", "entity_type", "_kind", "_key"), take=("first_ord",),
            weight="holders", spread_by=(F.col("batch_id"), F.col("row_ord")),
        )
        earlier = F.col("first_ord") < F.col("row_ord")
        return found.withColumns({
            "exact_kind": F.when(earlier, F.col("_kind")),
            "exact_peer_ord": F.when(earlier, F.col("first_ord")),
        }).drop("first_ord", "_kind", "_key")

    key = F.coalesce("key_email", "key_code")
    if one_key:
        return ask(records, kind, key)
    one = ask(records.filter(~both), kind, key)
    two = ask(records.filter(both), F.lit("email"), F.col("key_email")).withColumnsRenamed(
        {"exact_kind": "_e_kind", "exact_peer_ord": "_e_ord"}
    )
    code = F.when(F.col("_e_ord").isNull(), F.col("key_code"))
    two = ask(two, F.lit("code"), code).withColumns({
        "exact_kind": F.coalesce("_e_kind", "exact_kind"),
        "exact_peer_ord": F.coalesce("_e_ord", "exact_peer_ord"),
    }).drop("_e_kind", "_e_ord")
    return one.unionByName(two)
