"""Broadcasts behind a measured size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Data up to this many bytes may be sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

# Counted per row on top of its values.
ROW_OVERHEAD = 32


def text_bytes(df: DataFrame, columns: list[str]) -> int:
    """Bytes of the rows, measured by reading just these columns."""
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns]
    total = F.sum(reduce(Column.__add__, widths, F.lit(ROW_OVERHEAD)))
    return df.agg(total).first()[0] or 0


def is_small(n_bytes: int) -> bool:
    return n_bytes <= BROADCAST_BYTES


def keep_wanted(large: DataFrame, wanted: DataFrame, key: str, wanted_bytes: int) -> DataFrame:
    """Drop the rows of `large` whose key is not wanted, where that needs no shuffle of `large`.

    When the wanted keys are few they are broadcast and the scan of `large` keeps only what they
    match; otherwise `large` comes back as it is. Callers join on the key afterwards, so the result
    is the same either way.
    """
    if not is_small(wanted_bytes):
        return large
    return large.join(F.broadcast(wanted.select(key)), key, "left_semi")
