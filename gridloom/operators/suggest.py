"""Column-mapping suggestions for every sheet of a landing area at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.fixed_values import (
    ALIAS_CONFIDENCE, DIRECT_CONFIDENCE, ENTITY_TYPES, FIELD_ALIASES,
)
from gridloom.functions.text import norm_header
from gridloom.operators import skew
from gridloom.operators.normalize import header_key
from gridloom.operators.resolve import entity_by_name

_ENTRY = "array<struct<field:string,header:string,confidence:double>>"


def suggest_mapping(sheets: DataFrame) -> DataFrame:
    """Sheets (sheet_name, headers, entity_hint) with entity_type, mapping and needs_review.

    `mapping` lists (field, header, confidence) in field order. The work is per sheet, from the
    sheet's own header list: no explode, no join, no shuffle.
    """
    # an unknown hint says nothing
    hint = F.when(F.col("entity_hint").isin(*ENTITY_TYPES), F.col("entity_hint"))
    inferred = F.coalesce(hint, entity_by_name(F.col("sheet_name")))
    keyed = sheets.withColumns({
        "_type": inferred,
        "_names": F.reverse("headers"),
        "_keys": F.reverse(F.transform("headers", norm_header)),
    })

    def header(text: str) -> Column:
        at = F.array_position("_keys", header_key(text)).cast("int") - 1
        found = F.get("_names", at)
        return F.when(found != "", found)

    def entry(field: str, aliases: tuple[str, ...]) -> Column:
        direct = header(field)
        alias = F.coalesce(*[header(a) for a in aliases])
        confidence = F.when(direct.isNotNull(), DIRECT_CONFIDENCE).otherwise(ALIAS_CONFIDENCE)
        hit = F.coalesce(direct, alias)
        return F.when(hit.isNotNull(), F.struct(
            F.lit(field).alias("field"), hit.alias("header"), confidence.alias("confidence")
        ))

    mapping = F
    for name in ENTITY_TYPES:
        entries = [entry(f, a) for f, a in FIELD_ALIASES[name].items()]
        mapping = mapping.when(F.col("_type") == name, F.array_compact(F.array(*entries)))
    mapping = F.coalesce(mapping, F.array().cast(_ENTRY))
    return keyed.select(
        *sheets.columns,
        F.coalesce("_type", F.lit("PRODUCT")).alias("entity_type"),
        mapping.alias("mapping"),
    ).withColumn("needs_review", (F.size("mapping") == 0) | hint.isNull())


def scope_hint(sheets: DataFrame) -> DataFrame:
    """Keep an entity hint only where the file has a single sheet."""
    counts = sheets.groupBy("source_file").agg(F.count("*").alias("_n"))
    spread = (F.struct(*[F.col(c) for c in sheets.columns]),)
    known = skew.lookup(sheets, counts.withColumn("_one", F.col("_n") == 1), on=("source_file",),
                        take=("_one",), weight="_n", spread_by=spread)
    return known.withColumn("entity_hint", F.when(F.col("_one"), F.col("entity_hint"))).select(
        *sheets.columns
    )


def columns_map(mapping: Column) -> Column:
    """field -> header map of a suggestion, as a mapping table stores it."""
    pairs = F.transform(mapping, lambda m: F.struct(m["field"], m["header"]))
    return F.map_from_entries(pairs)
