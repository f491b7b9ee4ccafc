"""Text helpers: trimming, header normalisation and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.fixed_values import SAFE_NAME_MAX, TRIM_CHARS


def full_trim(c: Column) -> Column:
    """Trim every Unicode space; Spark's own trim removes plain blanks only."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def norm_header(c: Column) -> Column:
    """Lower-case, every run of other characters to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def match_key(c: Column) -> Column:
    """Trimmed lower-case key text, null when nothing is left."""
    return blank_to_null(F.lower(full_trim(c)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def safe_file_name(name: Column) -> Column:
    cleaned = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_"), 1, SAFE_NAME_MAX)
    return F.coalesce(blank_to_null(cleaned), F.lit("upload"))


def source_kind(name: Column) -> Column:
    """CSV or XLSX by extension, null when unsupported."""
    low = F.lower(name)
    return (
        F.when(low.endswith(".csv"), "CSV")
        .when(low.endswith(".xlsx") | low.endswith(".xlsm"), "XLSX")
    )
