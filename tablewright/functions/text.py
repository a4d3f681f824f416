"""Column expressions that read text the way the validators need it.

All are built-in expressions, none can throw: a value that doesn't parse gives
null, so they hold under ANSI mode too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of the accepted texts.
DAY = r"[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}"
CLOCK = r"T([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]Z?"
DAY_SPAN = r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"
NUMBER = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"
WORD_NUMBER = r"^[+-]?(inf|infinity|nan)$"
URL = r"^https?://[^\s]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def as_text(value: Column, data_type: str = "string") -> Column:
    """The text of a value; numbers that Spark writes with an exponent below 1e16 are written out."""
    if data_type in ("double", "float"):
        whole = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        plain = (F.abs(value) >= 1e7) & (F.abs(value) < 1e16)
        digits = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
        return F.when(plain & (value == F.floor(value)), whole).when(plain, digits).otherwise(value.cast("string"))
    return value.cast("string")


def trimmed(text: Column) -> Column:
    """Without spaces and no-break spaces at the ends; tabs and line ends stay."""
    return F.btrim(text, F.lit(" \u00a0"))


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def is_present(text: Column) -> Column:
    return text.isNotNull() & ~is_blank(text)


def is_absent(text: Column) -> Column:
    return text.isNull() | is_blank(text)


def to_double(text: Column) -> Column:
    word = F.lower(F.trim(text))
    named = F.when(word.rlike("nan$"), F.lit(float("nan"))).when(word.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double")).when(word.rlike(WORD_NUMBER), named)


def to_integer(text: Column) -> Column:
    """Fractions are rounded half away from zero."""
    return F.when(text.rlike(NUMBER), F.round(F.regexp_replace(F.trim(text), "_", "").try_cast("double")).try_cast("int"))


def is_iso8601(text: Column) -> Column:
    """A year, a year and month, a day, a day with a time, or two days joined by a slash; one look at the shape, and the calendar only where there is a day."""
    own = F.btrim(text, F.lit(" \t\n\r\f\v"))
    day = F.regexp_extract(own, f"^({DAY})", 1)
    shaped = F.when(own.rlike(f"^({DAY}({CLOCK})?|[0-9]{{1,4}}-(0?[1-9]|1[0-2])|[0-9]{{1,4}})$"), (day == "") | F.try_to_date(day, "y-M-d").isNotNull())
    return F.coalesce(shaped, F.lit(False)) | text.rlike(DAY_SPAN)


def has_format(text: Column, name: str) -> Column:
    """Whether text is of the named format."""
    match name:
        case "iso8601":
            return is_iso8601(text)
        case "url":
            return text.rlike(URL)
        case "uuid":
            return text.rlike(UUID)
        case "email":
            return text.rlike(EMAIL)
        case "decimal-degrees":
            return to_double(text).isNotNull()
        case "integer":
            return to_integer(text).isNotNull()
    raise ValueError(f"unknown format {name!r}")
