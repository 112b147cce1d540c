"""Positions in a total order and pages of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landroll.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row count of a partition in the low bits


def with_positions(
    df: DataFrame, order: list[Column], position: str = "position", *, within: tuple[str, ...] = ()
) -> DataFrame:
    """Add the 1-based position in a total order, over all rows or within groups.

    No group has to fit into one task: the rows are range-partitioned by group and `order`, each
    partition counts its rows per group, and the counts of the partitions before give the offset.
    The partition layout must not change between the two uses, so the sorted rows are checkpointed.
    The rows are joined to the offsets on partition and group, and no partition is larger than the
    sort made it. Over all rows there is one offset per partition, which is broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.orderBy(*[F.asc(g) for g in within], *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .checkpoint()
    )
    runs = placed.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = runs.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(within)], offset.alias("_offset")
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(within):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(offsets if within else F.broadcast(offsets), same)
    return joined.select(*df.columns, (F.col("_offset") + F.col("_row")).alias(position))


def page_of(df: DataFrame, order: list[Column], page: int, rows_per_page: int) -> DataFrame:
    """Page `page` (from 1) in a total order. For reading on and on, `rows_after` is cheaper."""
    return df.orderBy(*order).offset((page - 1) * rows_per_page).limit(rows_per_page)


def rows_after(df: DataFrame, keys: list[tuple[str, str]], after: tuple, rows_per_page: int) -> DataFrame:
    """The rows that follow a given one in the order of `keys`, (column, "asc" or "desc") each.

    `after` holds the key values of the last row seen, none of them null. The first key's bound is a plain
    filter, which the scan can use to skip files; rows with a null key are not part of the order.
    """
    follows = F.lit(False)
    tied = F.lit(True)
    for (column, direction), value in zip(keys, after, strict=True):
        beyond = F.col(column) < F.lit(value) if direction == "desc" else F.col(column) > F.lit(value)
        follows = follows | (tied & beyond)
        tied = tied & (F.col(column) == F.lit(value))
    first, direction = keys[0]
    bound = F.col(first) <= F.lit(after[0]) if direction == "desc" else F.col(first) >= F.lit(after[0])
    order = [F.desc(c) if d == "desc" else F.asc(c) for c, d in keys]
    return df.where(bound & follows).orderBy(*order).limit(rows_per_page)
