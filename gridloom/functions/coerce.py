"""Coercion of cell text into canonical values.

All functions take the cell as `cell_text` leaves it: trimmed, null for an absent or empty cell
and '' for a cell of blanks only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.fixed_values import DATE_FIELDS, EMAIL_FIELDS, NUMERIC_FIELDS
from gridloom.functions.text import full_trim

# Accepted date layouts; any other text is kept as it stands. Text without an offset is UTC.
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
_ISO = rf"^\d{{4}}(?:-\d{{1,2}}(?:-\d{{1,2}}(?:[T ]{_CLOCK})?)?)?$"
_ISO_ZONED = rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK} ?(?:Z|[+-]\d{{2}}:?\d{{2}})$"
_MONTH_FIRST = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})( {_CLOCK})?$"
_YEAR_FIRST = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})( {_CLOCK})?$"
_MONTH_NAMED = r"^([A-Za-z]{3})[a-z]* (\d{1,2}),? (\d{4})$"
_DAY_NAMED = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})$"


def cell_text(c: Column) -> Column:
    return F.when(c != "", full_trim(c))


def to_number(text: Column) -> Column:
    """Keep digits, dots and minus signs, then read as a double.

    Text that leaves nothing reads as 0; text that leaves a malformed number is absent.
    """
    kept = F.regexp_replace(text, r"[^0-9.\-]", "")
    number = kept.try_cast("double")
    return F.when(kept == "", 0.0).when(
        kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$") & (F.abs(number) < float("inf")), number
    )


def parse_date(text: Column) -> Column:
    """UTC wall time of a date text, null when no accepted layout fits."""
    def wall(c: Column) -> Column:
        # Whole milliseconds; the clock may carry more digits.
        return F.regexp_replace(c, r"(\.\d{3})\d+", "$1").try_cast("timestamp_ntz")

    def day(c: Column) -> Column:
        return F.try_to_date(c, "d MMM yyyy").cast("timestamp_ntz")

    instant = F.regexp_replace(text, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2").try_cast("timestamp")
    zoned = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.floor(F.unix_micros(instant) / 1000).cast("decimal(20,0)") / F.lit(1000)
    )
    return (
        F.when(text.rlike(_ISO), wall(text))
        .when(text.rlike(_MONTH_FIRST), wall(F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2$4")))
        .when(text.rlike(_YEAR_FIRST), wall(F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3$4")))
        .when(text.rlike(_ISO_ZONED), zoned)
        .when(text.rlike(_MONTH_NAMED), day(F.regexp_replace(text, _MONTH_NAMED, "$2 $1 $3")))
        .when(text.rlike(_DAY_NAMED), day(F.regexp_replace(text, _DAY_NAMED, "$1 $2 $3")))
    )


def iso_text(ts: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ss.SSSZ` of a wall time, independent of the session zone."""
    s = ts.cast("string")
    return F.concat(
        F.translate(F.substring(s, 1, 19), " ", "T"), F.lit("."),
        F.rpad(F.substring(s, 21, 3), 3, "0"), F.lit("Z"),
    )


def coerce(field: str, text: Column, parsed: Column | None = None) -> Column:
    """Canonical value of a field; `parsed` is a date field's text already parsed."""
    if field in NUMERIC_FIELDS:
        return to_number(text)
    if field in EMAIL_FIELDS:
        return F.lower(text)
    if field in DATE_FIELDS:
        return F.coalesce(iso_text(parse_date(text) if parsed is None else parsed), text)
    return text
