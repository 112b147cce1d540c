"""Timestamps as UTC wall-clock values, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_wall_clock(df: DataFrame, column: str) -> Column:
    """The column as TIMESTAMP_NTZ in UTC (zone-less columns already are)."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), F.col(column).cast("timestamp_ntz"))
    return F.col(column)


def utc_iso_text(df: DataFrame, column: str) -> Column:
    """ISO-8601 text with six fraction digits and `+00:00`."""
    text = utc_wall_clock(df, column).cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.lit("."),
        F.rpad(F.substring(text, 21, 6), 6, "0"),
        F.lit("+00:00"),
    )


def utc_day(df: DataFrame, column: str) -> Column:
    return F.to_date(utc_wall_clock(df, column))
