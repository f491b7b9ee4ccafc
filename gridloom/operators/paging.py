"""Keyset pages over lists ordered newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.fixed_values import PAGE_DEFAULT, PAGE_MAX


def page(
    rows: DataFrame, limit: int = PAGE_DEFAULT, cursor: str | None = None,
    id_column: str = "id", at: str = "created_at",
) -> DataFrame:
    """At most `limit` rows after the cursor row, with next_cursor (null on the last page).

    The cursor is the id of the last row seen and is itself left out. One row more than asked is
    taken to learn whether there is more; sorting stays a top-k.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")
    if cursor is not None:
        seen = rows.filter(F.col(id_column) == cursor).select(F.col(at).cast("string")).first()
        if seen is None:
            rows = rows.filter(F.lit(False))
        else:
            then = F.lit(seen[0]).cast(rows.schema[at].dataType)
            same = (F.col(at) == then) & (F.col(id_column) < cursor)
            rows = rows.filter((F.col(at) < then) | same)
    newest = [F.col(at).desc(), F.col(id_column).desc()]
    top = rows.orderBy(*newest).limit(limit + 1)
    # At most limit + 1 rows are left here.
    order = Window.orderBy(*newest)
    everything = Window.partitionBy(F.lit(1))
    numbered = top.withColumns({
        "_n": F.row_number().over(order), "_total": F.count("*").over(everything),
    })
    last = F.max(F.when((F.col("_n") == limit) & (F.col("_total") > limit), F.col(id_column)))
    return (
        numbered.withColumn("next_cursor", last.over(everything))
        .filter(F.col("_n") <= limit).drop("_n", "_total")
    )
