"""Row-level rules of the import contract: requests, idempotency and error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.fixed_values import ENTITY_TYPES, ERROR_STATUS, PUBLISH_OPS
from gridloom.functions.publishing import external_id
from gridloom.operators import skew


def _one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*allowed), F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def request_errors() -> Column:
    """Problems of an apply request (op, entity_type, external_id, idempotency_key)."""
    return F.array_compact(F.array(
        F.when(~_one_of(F.col("op"), PUBLISH_OPS), "op: not a publish operation"),
        F.when(~_one_of(F.col("entity_type"), ENTITY_TYPES), "entityType: not an entity type"),
        F.when(F.col("external_id") == "", "externalId: must not be empty"),
        F.when(~_filled(F.col("idempotency_key")), "idempotencyKey: must not be empty"),
    ))


def compensate_errors() -> Column:
    """Problems of a compensate request (original_op, entity_type, external_id, idempotency_key)."""
    return F.array_compact(F.array(
        F.when(~_one_of(F.col("original_op"), PUBLISH_OPS), "originalOp: not a publish operation"),
        F.when(~_one_of(F.col("entity_type"), ENTITY_TYPES), "entityType: not an entity type"),
        F.when(~_filled(F.col("external_id")), "externalId: must not be empty"),
        F.when(~_filled(F.col("idempotency_key")), "idempotencyKey: must not be empty"),
    ))


def external_id_missing() -> Column:
    """Update, link and deactivate need the external id they act on."""
    return F.coalesce(F.col("op").isin("UPDATE", "LINK", "DEACTIVATE"), F.lit(False)) & ~_filled(
        F.col("external_id")
    )


def apply_once(requests: DataFrame, order: str = "request_ord") -> DataFrame:
    """Requests with the external id their key resolves to; repeats are flagged idempotent.

    The first request of a key decides; a repeated key returns the same id.
    """
    firsts = requests.groupBy("idempotency_key").agg(
        F.count("*").alias("n_refs"),
        F.min(order).alias("_first"),
        F.min_by("external_id", order).alias("_given"),
        F.min_by("entity_type", order).alias("_type"),
    )
    answered = skew.lookup(
        requests, firsts, on=("idempotency_key",), take=("_first", "_given", "_type"),
        weight="n_refs", spread_by=(F.col(order),),
    )
    return answered.withColumns({
        "result_external_id": external_id(F.col("_given"), F.col("_type"), F.col("idempotency_key")),
        "idempotent": F.col(order) > F.col("_first"),
    }).drop("_first", "_given", "_type")


def key_conflicts(requests: DataFrame) -> DataFrame:
    """Idempotency keys reused with a different payload.

    Lowest and highest payload hash suffice to see a difference, so the aggregate stays small
    and combines before the shuffle.
    """
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    return requests.groupBy("idempotency_key").agg(
        F.count("*").alias("requests"), F.min(digest).alias("_lo"), F.max(digest).alias("_hi")
    ).filter("_lo <> _hi").select("idempotency_key", "requests", F.lit("conflict").alias("code"))


def error_code(code: Column) -> Column:
    """A known import error code, anything else counts as internal."""
    return F.when(code.isin(*ERROR_STATUS), code).otherwise("internal")


def error_status(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ERROR_STATUS.items() for x in pair])
    return F.try_element_at(known, error_code(code))
