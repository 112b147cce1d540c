"""Text expressions: blanks, defaults, joins of optional parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points (first, last) of every character that Unicode-aware trimming removes.
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(code) for low, high in WHITESPACE_RANGES for code in range(low, high + 1))


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Trim all whitespace at both ends (`trim` alone only removes spaces)."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def squeeze_ws(c: Column | str) -> Column:
    """Replace each run of whitespace by one space."""
    return F.regexp_replace(as_column(c), f"[{WHITESPACE}]+", " ")


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(as_column(c), F.lit(""))


def has_text(c: Column | str) -> Column:
    """True when the value is neither null nor empty; never null itself."""
    return F.coalesce(as_column(c) != "", F.lit(False))


def or_default(c: Column | str, default: str) -> Column:
    """The value, or `default` when it is null or empty."""
    return F.coalesce(empty_to_null(c), F.lit(default))


def join_nonempty(columns: list[Column | str], separator: str, default: str) -> Column:
    """Join the non-empty parts; `default` when there is none."""
    return or_default(F.concat_ws(separator, *[empty_to_null(c) for c in columns]), default)


def contains_ignoring_case(c: Column | str, term: str) -> Column:
    """Literal substring test; `%` and `_` in the term mean themselves."""
    return F.coalesce(F.contains(F.lower(as_column(c)), F.lower(F.lit(term))), F.lit(False))


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match, trimmed; null when the pattern does not match at all.

    The match is cut out once, so the long text is scanned a single time.
    """
    return trim_ws(F.regexp_extract(F.regexp_substr(as_column(c), F.lit(pattern)), pattern, group))
