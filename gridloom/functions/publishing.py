"""Identifiers and payloads of publish actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idempotency_key(batch_id: Column, record_id: Column, op: Column) -> Column:
    return F.concat_ws(":", batch_id, record_id, op)


def external_id(given: Column, entity_type: Column, key: Column) -> Column:
    """The given id, else one derived from the idempotency key so retries agree."""
    derived = F.concat(
        F.lit("ext_"), F.lower(entity_type), F.lit("_"), F.substring(F.sha1(key), 1, 16)
    )
    return F.coalesce(given, derived)


def payload_json(data: Column) -> Column:
    """Canonical body as JSON text; absent fields are left out."""
    return F.to_json(data)
