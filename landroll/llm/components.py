"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import SMALL_ROWS, saved


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component): each linked node with the smallest node it reaches.

    Every step is a group minimum, combined on the map side, and a join: with the minima sent to the links where the counted links are
    few, else one that the adaptive planner may split. So a hub costs no more than its rows; the table is written after each round. Null
    ends and links of a node to itself are no links. No links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = saved(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        sent = F.broadcast if state[0] <= SMALL_ROWS else lambda minima: minima
        large = both.where("v > u").join(sent(least), "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        first = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(sent(first), "high")
        small = small.select(F.col("m").alias("low"), "high").union(
            small.where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        )
        edges = saved(small.distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a checksum of them: equal states mean that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
