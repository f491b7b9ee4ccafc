"""Edit-distance similarity of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.fixed_values import FUZZY_THRESHOLD


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 when one is empty, else 1 - distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .otherwise(1.0 - F.levenshtein(a, b) / longer)
    )


def edit_budget(longer: Column) -> Column:
    """Most edits a pair may differ by when its longer text has this length.

    The small term keeps products such as 0.15 * 20 from rounding below the whole number;
    the exact test on the similarity itself follows later.
    """
    return F.floor(longer * (1.0 - FUZZY_THRESHOLD) + 1e-6).cast("int")
