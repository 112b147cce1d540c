"""Map layers: usable coordinates, colours, areas, popups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.functions.text import or_default

# Colour per claim type, the default colour, half the side of an area in degrees,
# and the text of a missing popup field.
TYPE_COLORS = {"IFR": "#0d6efd", "CR": "#198754", "CFR": "#ffc107"}
OTHER_COLOR = "#6c757d"
HALF_SIDE = 0.01
NOT_AVAILABLE = "N/A"


def _usable(c: Column) -> Column:
    """Neither null, zero nor NaN; the value is computed once per test."""
    return F.nanvl(c, F.lit(0.0)) != 0


def valid_points(df: DataFrame, *, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Claims that can be drawn: both coordinates are numbers other than zero."""
    return df.where(_usable(F.col(latitude)) & _usable(F.col(longitude)))


def claim_color(claim_type: str = "claim_type") -> Column:
    color = F.lit(OTHER_COLOR)
    for name, value in TYPE_COLORS.items():
        color = F.when(F.col(claim_type) == name, value).otherwise(color)
    return color


def with_color(df: DataFrame, *, claim_type: str = "claim_type") -> DataFrame:
    return df.withColumn("color", claim_color(claim_type))


def with_area(
    df: DataFrame,
    *,
    latitude: str = "latitude",
    longitude: str = "longitude",
    half_side: float = HALF_SIDE,
) -> DataFrame:
    """Add `area`: four corners (lat, lon) round the point, south-west first, then north-west."""
    lat, lon = F.col(latitude), F.col(longitude)
    south, north, west, east = lat - half_side, lat + half_side, lon - half_side, lon + half_side
    corners = [(south, west), (north, west), (north, east), (south, east)]
    return df.withColumn(
        "area", F.array(*[F.struct(y.alias("lat"), x.alias("lon")) for y, x in corners])
    )


def popups(df: DataFrame) -> DataFrame:
    fields = ("name", "village", "district", "claim_type", "status")
    return df.select("id", *[or_default(c, NOT_AVAILABLE).alias(c) for c in fields])
