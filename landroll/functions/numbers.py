"""Number expressions: reading dirty text, writing display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landroll.functions.text import WHITESPACE, as_column

# Fixed value: shown for a missing number or text.
DASH = "—"

# A whole text that is one number, blanks round it allowed.
PLAIN_NUMBER = rf"^[{WHITESPACE}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[{WHITESPACE}]*$"


def parse_number(c: Column | str) -> Column:
    """Read a dirty cell: keep digits, dots and minus signs, null when that is not a number.

    Markers such as `NA`, `NA/NR` or `-` hold no digit, so they read as null without a list of them.
    """
    return F.regexp_replace(as_column(c), r"[^0-9.\-]", "").try_cast("double")


def parse_plain_number(c: Column | str) -> Column:
    """Read text that is a number as a whole; null for anything else (`5d`, `abc`, empty)."""
    return F.regexp_extract(as_column(c), PLAIN_NUMBER, 1).try_cast("double")


def _without_trailing_zeros(fixed: Column) -> Column:
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def number_text(c: Column | str) -> Column:
    """Shortest positional text of a number: `8.5`, `8`."""
    return _without_trailing_zeros(as_column(c).try_cast("decimal(38,15)").cast("string"))


def indian_number(c: Column | str) -> Column:
    """Text with Indian digit groups and at most three decimals: `67,56,280`."""
    value = as_column(c).cast("double")
    whole = F.concat(F.regexp_replace(F.format_number(value, 0), ",", ""), F.lit(".000"))  # beyond 35 digits there is no fraction
    fixed = F.coalesce(value.try_cast("decimal(38,3)").cast("string"), whole)
    grouped = F.regexp_replace(fixed, r"(?<=\d)(?=(\d\d)+\d\.)", ",")
    return (
        F.when(value.isNull() | F.isnan(value), DASH)
        .when(value == float("inf"), "∞")
        .when(value == float("-inf"), "-∞")
        .otherwise(_without_trailing_zeros(grouped))
    )


def percent_text(c: Column | str) -> Column:
    """One decimal and a percent sign, a dash for null."""
    value = as_column(c)
    return F.when(value.isNull(), DASH).otherwise(F.format_string("%.1f%%", value))
