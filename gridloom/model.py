"""Row shapes, identifiers and the total row order shared by every stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.fixed_values import FIELD_ALIASES, NUMERIC_FIELDS

EXTRACTED_SCHEMA = (
    "batch_id string, source_file string, sheet_index int, sheet_name string, "
    "source_row_index bigint, entity_type string, "
    "cells array<struct<header:string,value:string>>"
)
MAPPING_SCHEMA = (
    "batch_id string, position int, entity_type string, sheet string, columns map<string,string>"
)
DECISION_SCHEMA = (
    "review_item_id string, resolution string, resolved_by string, decided_at timestamp_ntz, "
    "fields map<string,string>, target_record_id string, target_external_id string"
)
OUTCOME_SCHEMA = "action_id string, ok boolean, external_id string, error string"
SNAPSHOT_SCHEMA = (
    "entity_type string, external_id string, email string, code string, name string"
)

#: every canonical field once, in schema order
CANONICAL_FIELDS: tuple[str, ...] = tuple(
    dict.fromkeys(f for fields in FIELD_ALIASES.values() for f in fields)
)

# A row's place within its batch packs into one bigint: sheet number above, row number
# below. Ordering, minima and chunking then work on a primitive.
ROW_BITS = 40
ROW_MASK = (1 << ROW_BITS) - 1


def field_type(field: str) -> str:
    return "double" if field in NUMERIC_FIELDS else "string"


def canonical_type() -> str:
    """DDL of the canonical body: the union of all entity fields, null meaning absent."""
    return "struct<" + ",".join(f"{f}:{field_type(f)}" for f in CANONICAL_FIELDS) + ">"


def row_ord(sheet_index: Column, source_row_index: Column) -> Column:
    return F.shiftleft(sheet_index.cast("bigint"), ROW_BITS) + source_row_index.cast("bigint")


def record_id(batch_id: Column, ord_: Column) -> Column:
    """Stable id `batch:sheet:row`; a peer's id follows from its position alone."""
    return F.concat_ws(
        ":", batch_id, F.shiftright(ord_, ROW_BITS), ord_.bitwiseAND(F.lit(ROW_MASK))
    )


def row_ord_of(record_id_: Column) -> Column:
    """The packed row order back from a record's id."""
    return row_ord(F.split_part(record_id_, F.lit(":"), F.lit(-2)).cast("int"),
                   F.split_part(record_id_, F.lit(":"), F.lit(-1)).cast("bigint"))
