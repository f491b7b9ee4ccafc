"""Extracted rows to canonical rows: field resolution, coercion, validation and match keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model
from gridloom.fixed_values import (
    DATE_FIELDS, EMAIL_PATTERN, ENTITY_TYPES, FIELD_ALIASES, KEY_FIELDS, MSG_BAD_EMAIL, MSG_REQUIRED,
    MSG_TOO_SHORT, PRIORITY, VALIDATION_TEXT,
)
from gridloom.functions.coerce import cell_text, coerce, iso_text, parse_date
from gridloom.functions.text import full_trim, match_key, norm_header


def header_key(text: str) -> str:
    """Driver-side twin of `norm_header` for the fixed alias spellings."""
    kept = "".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in text.lower())
    return " ".join(kept.split())


def alias_keys(entity_type: str, field: str) -> list[str]:
    """Normalised spellings of a field in look-up order, the field's own name first."""
    return list(dict.fromkeys(header_key(a) for a in (field, *FIELD_ALIASES[entity_type][field])))


def normalize(
    extracted: DataFrame, entity_types: Sequence[str] = ENTITY_TYPES, keep: Sequence[str] = ()
) -> DataFrame:
    """Canonical rows with match keys and validation messages, one per extracted row.

    `extracted` holds batch_id, sheet_index, source_row_index, entity_type, cells and,
    optionally, columns (canonical field -> source header). Naming the entity types that
    occur keeps the expression small. No shuffle, join or Python takes part. Cell arrays are
    read back to front, so of several headers with the same key the last one wins.
    """
    has_map = "columns" in extracted.columns
    cells = extracted.select(
        "batch_id", "sheet_index", "source_row_index", "entity_type", *keep,
        *(["columns", F.reverse(F.col("cells.value")).alias("_given")] if has_map else []),
        F.reverse(F.col("cells.header")).alias("_headers"),
        F.transform(F.reverse(F.col("cells.value")), cell_text).alias("_values"),
    ).withColumn("_keys", F.transform("_headers", norm_header))

    def place(names: str, wanted: Column) -> Column:
        # A missing header gives position 0, hence index -1, hence null.
        return F.array_position(F.col(names), wanted).cast("int") - 1

    def raw(entity_type: str, field: str) -> Column:
        hits = [F.get("_values", place("_keys", F.lit(k))) for k in alias_keys(entity_type, field)]
        by_alias = F.get(F.array_compact(F.array(*hits)), F.lit(0))
        if not has_map:
            return by_alias
        mapped = F.try_element_at(F.col("columns"), F.lit(field))
        exact = place("_headers", mapped)
        # An empty cell under the exact header is final; only a missing one falls through.
        by_map = F.when(F.get("_given", exact).isNotNull(), F.get("_values", exact)).otherwise(
            F.get("_values", place("_keys", norm_header(mapped)))
        )
        return F.when(mapped != "", by_map).otherwise(by_alias)

    def raw_of(field: str) -> Column:
        owners = [e for e in entity_types if field in FIELD_ALIASES[e]]
        return _by_entity({e: raw(e, field) for e in owners})

    used = [f for f in model.CANONICAL_FIELDS
            if any(f in FIELD_ALIASES[e] for e in entity_types)]
    raws = cells.select(
        "batch_id", "sheet_index", "source_row_index", "entity_type", *keep,
        *[raw_of(f).alias(f"_raw_{f}") for f in used],
    )
    for f in DATE_FIELDS:
        if f in used:
            # Parsed once: both the ISO text and the key date read it.
            raws = raws.withColumn("_date", parse_date(F.col(f"_raw_{f}")))

    def value(field: str) -> Column:
        if field not in used:
            return F.lit(None).cast(model.field_type(field))
        return coerce(field, F.col(f"_raw_{field}"), F.col("_date") if field in DATE_FIELDS else None)

    data = F.struct(*[value(f).alias(f) for f in model.CANONICAL_FIELDS])
    ord_ = model.row_ord(F.col("sheet_index"), F.col("source_row_index"))
    body = raws.select(
        "batch_id", "entity_type", *keep, ord_.alias("row_ord"), data.alias("data"),
        *(["_date"] if "_date" in raws.columns else []),
    )
    return derive(body, entity_types).select(
        "batch_id",
        model.record_id(F.col("batch_id"), F.col("row_ord")).alias("record_id"),
        "row_ord", "entity_type", F.lit("DRAFT").alias("status"), *keep, "data",
        "dedupe_key", "key_email", "key_code", "key_name", "key_date", "validation_errors",
    )


def derive(rows: DataFrame, entity_types: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """Add (or replace) validation messages and match keys from `data`.

    A `_date` column, when present, is the booking date already parsed.
    """
    parsed = F.col("_date") if "_date" in rows.columns else None
    return rows.withColumns({
        "validation_errors": validation_errors(entity_types),
        "key_email": _key("email", entity_types),
        "key_code": _key("code", entity_types),
        "key_name": _key("name", entity_types),
        "key_date": _key_date(entity_types, parsed),
    }).withColumn(
        "dedupe_key",
        F.coalesce("key_email", "key_code", "key_name", iso_text(F.col("key_date"))),
    )


def validation_errors(entity_types: Sequence[str] = ENTITY_TYPES) -> Column:
    """`field: message` texts in field order; only names and e-mails can fail."""
    name, full, email = F.col("data.name"), F.col("data.fullName"), F.col("data.email")
    checks: dict[str, list[Column]] = {
        "PRODUCT": [
            F.when(name.isNull(), f"name: {MSG_REQUIRED}").when(name == "", f"name: {MSG_TOO_SHORT}")
        ],
    }
    person = [
        F.when(full == "", f"fullName: {MSG_TOO_SHORT}"),
        F.when(~email.rlike(EMAIL_PATTERN), f"email: {MSG_BAD_EMAIL}"),
    ]
    checks["TRAVELER"] = person
    checks["GUIDE"] = person
    by_entity = {
        e: F.array_compact(F.array(*checks[e])) for e in entity_types if e in checks
    }
    nothing = F.array().cast("array<string>")
    return F.coalesce(_by_entity(by_entity), nothing) if by_entity else nothing


def _key(kind: str, entity_types: Sequence[str]) -> Column:
    fields = {e: match_key(F.col(f"data.{KEY_FIELDS[e][kind]}"))
              for e in entity_types if kind in KEY_FIELDS[e]}
    return _by_entity(fields) if fields else F.lit(None).cast("string")


def _key_date(entity_types: Sequence[str], parsed: Column | None) -> Column:
    fields = {e: parsed if parsed is not None
              else parse_date(full_trim(F.col(f"data.{KEY_FIELDS[e]['date']}")))
              for e in entity_types if "date" in KEY_FIELDS[e]}
    return _by_entity(fields) if fields else F.lit(None).cast("timestamp_ntz")


def _by_entity(values: dict[str, Column]) -> Column:
    out = F
    for entity_type, value in values.items():
        out = out.when(F.col("entity_type") == entity_type, value)
    return out


def validation_items(canonical: DataFrame) -> DataFrame:
    """An open review item for every row that failed validation."""
    text = F.format_string(VALIDATION_TEXT, F.array_join("validation_errors", "; "))
    return canonical.filter(F.size("validation_errors") > 0).select(
        "batch_id",
        F.concat_ws(":", "record_id", F.lit("VALIDATION_ERROR")).alias("review_item_id"),
        "record_id", "row_ord", "entity_type",
        F.lit("VALIDATION_ERROR").alias("reason"),
        F.lit("OPEN").alias("status"),
        F.lit(PRIORITY["VALIDATION_ERROR"]).alias("priority"),
        text.alias("explanation"),
        F.lit(None).cast("string").alias("strategy"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("peer_record_id"),
    )


def normalized_counts(canonical: DataFrame) -> DataFrame:
    """Rows and validation flags per batch and entity type."""
    return canonical.groupBy("batch_id", "entity_type").agg(
        F.count("*").alias("normalized"),
        F.count_if(F.size("validation_errors") > 0).alias("validation_flags"),
    )
