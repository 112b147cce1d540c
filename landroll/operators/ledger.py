"""Ledger jobs: listing, search, facets, pages, projections, export lines."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.functions.numbers import DASH, number_text, parse_plain_number
from landroll.functions.text import (
    contains_ignoring_case,
    empty_to_null,
    join_nonempty,
    or_default,
)
from landroll.functions.times import utc_iso_text
from landroll.operators.ordering import page_of, rows_after

# Result sizes, labels and defaults that users of the ledger see.
ROWS_PER_PAGE = 10
DEFAULT_STATUS = "Pending"
DEFAULT_TYPE = "Individual"
NO_NAME = "Unnamed claimant"
NO_VILLAGE = "Village N/A"
NO_LOCATION = "Location N/A"
DETAIL_TITLE = "Claim record"
DETAIL_NO_LOCATION = "Location not recorded"
DETAIL_NO_TEXT = "No raw text available for this claim."
PART_SEPARATOR = " · "
SEARCH_COLUMNS = ("name", "village", "district")
EXPORT_COLUMNS = {
    "id": "ID",
    "name": "Name",
    "village": "Village",
    "district": "District",
    "state": "State",
    "status": "Status",
    "claim_type": "Claim Type",
    "created_at": "Created At",
}


def newest_first(created_at: str = "created_at", id_col: str = "id") -> list[Column]:
    return [F.desc(created_at), F.desc(id_col)]


def listed(df: DataFrame, *, created_at: str = "created_at") -> DataFrame:
    """Claims that a time-ordered listing shows: those that have a timestamp."""
    return df.where(F.col(created_at).isNotNull())


def list_claims(df: DataFrame, *, created_at: str = "created_at", id_col: str = "id") -> DataFrame:
    """The listing, newest first; ties by id in the same direction."""
    return listed(df, created_at=created_at).orderBy(*newest_first(created_at, id_col))


def coerce_coordinates(
    df: DataFrame, *, latitude: str = "latitude_in", longitude: str = "longitude_in"
) -> DataFrame:
    """Add typed `latitude` and `longitude`; the text as it came stays beside them."""
    return df.withColumns(
        {"latitude": parse_plain_number(latitude), "longitude": parse_plain_number(longitude)}
    )


def default_status(df: DataFrame, *, status: str = "status") -> DataFrame:
    return df.withColumn(status, or_default(status, DEFAULT_STATUS))


def search(df: DataFrame, term: str, *, columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case; an empty term keeps all."""
    if not term:
        return df
    return df.where(reduce(or_, [contains_ignoring_case(c, term) for c in columns]))


def facet_filter(
    df: DataFrame, *, missing: dict[str, str] | None = None, **choices: str | None
) -> DataFrame:
    """Exact matches on the chosen facets; an empty choice filters nothing.

    `missing` names the value under which a facet shows null and empty (by default the ledger's
    default status), so the filter may come before `default_status`. On stored columns it then
    reaches the file scan, which it could not through the defaulted column.
    """
    missing = {"status": DEFAULT_STATUS} if missing is None else missing

    def test(column: str, value: str) -> Column:
        c = F.col(column)
        return c.isNull() | c.isin("", value) if missing.get(column) == value else c == value

    tests = [test(column, value) for column, value in choices.items() if value]
    return df.where(reduce(and_, tests)) if tests else df


def search_and_facets(df: DataFrame, term: str, **choices: str | None) -> DataFrame:
    return search(facet_filter(df, **choices), term)


def claim_by_id(df: DataFrame, claim_id: str, *, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == claim_id)


def serialized(df: DataFrame, *, created_at: str = "created_at", id_col: str = "id") -> DataFrame:
    """`id` first, the timestamp as ISO-8601 text in UTC."""
    others = [c for c in df.columns if c != id_col]
    iso = utc_iso_text(df, created_at).alias(created_at)
    return df.select(id_col, *[iso if c == created_at else F.col(c) for c in others])


def sparse_json(df: DataFrame, *, id_col: str = "id") -> DataFrame:
    """One JSON document per row, without the keys that are null."""
    return df.select(id_col, F.to_json(F.struct(*df.columns)).alias("json"))


def ledger_rows(df: DataFrame) -> DataFrame:
    """Display columns of a ledger row."""
    return df.select(
        "id",
        or_default("name", NO_NAME).alias("claimant"),
        F.concat(F.lit("#"), F.substring("id", 1, 8)).alias("short_id"),
        or_default("village", NO_VILLAGE).alias("village"),
        join_nonempty(["district", "state"], PART_SEPARATOR, NO_LOCATION).alias("location"),
        or_default("claim_type", DEFAULT_TYPE).alias("claim_type"),
        or_default("status", DEFAULT_STATUS).alias("status"),
    )


def coordinate_text(value: str, raw: str) -> Column:
    """A number prints as number; zero and text that is no number keep their input form."""
    return F.coalesce(number_text(F.nullif(F.col(value), F.lit(0.0))), empty_to_null(raw))


def detail_rows(
    df: DataFrame, *, latitude_in: str = "latitude_in", longitude_in: str = "longitude_in"
) -> DataFrame:
    """Display columns of a claim page, for all rows given."""
    lat = coordinate_text("latitude", latitude_in)
    lon = coordinate_text("longitude", longitude_in)
    coordinates = F.concat(lat, F.lit(", "), lon)  # null when either is
    return df.select(
        "id",
        or_default("name", DETAIL_TITLE).alias("title"),
        join_nonempty(["village", "district", "state"], PART_SEPARATOR, DETAIL_NO_LOCATION).alias("subtitle"),
        F.concat(F.lit("#"), F.substring("id", 1, 10)).alias("short_id"),
        or_default("claim_type", DEFAULT_TYPE).alias("type_chip"),
        or_default("status", DEFAULT_STATUS).alias("status_chip"),
        *[or_default(c, DASH).alias(c) for c in ("name", "village", "district", "state", "claim_type")],
        F.coalesce(coordinates, F.lit(DASH)).alias("coordinates"),
        or_default("raw_text", DETAIL_NO_TEXT).alias("raw_text"),
    )


def facet_values(
    df: DataFrame, facet: str, *, created_at: str = "created_at", id_col: str = "id"
) -> DataFrame:
    """Distinct non-empty values of a facet in the order the listing first shows them.

    The listing is newest first, so "first shown" is the greatest (timestamp, id). Each task sends
    one row per value.
    """
    shown = F.max(F.struct(F.col(created_at).alias("at"), F.col(id_col).alias("id")))
    return (
        df.where(F.col(facet) != "")
        .groupBy(F.col(facet).alias("value"))
        .agg(shown.alias("shown"))
        .select("value", F.col("shown.at").alias("first_seen_at"), F.col("shown.id").alias("first_seen_id"))
        .orderBy(F.desc("first_seen_at"), F.desc("first_seen_id"), "value")
    )


def ledger_page(df: DataFrame, page: int, *, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """One page of the (filtered) ledger, newest first."""
    return page_of(df, newest_first(), page, rows_per_page)


def ledger_after(df: DataFrame, after: tuple, *, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """The page behind a row given by its `(created_at, id)`, newest first: for reading deep pages one by one."""
    return rows_after(df, [("created_at", "desc"), ("id", "desc")], after, rows_per_page)


def page_count(df: DataFrame, *, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """Number of rows and of pages."""
    n = F.count("*")
    return df.agg(n.alias("n_claims"), F.ceil(n / F.lit(rows_per_page)).alias("n_pages"))


def export_columns(df: DataFrame) -> DataFrame:
    """The eight export columns in order, timestamp as text, still under their column names."""
    created = utc_iso_text(df, "created_at").alias("created_at")
    return df.select(*[created if c == "created_at" else F.col(c) for c in EXPORT_COLUMNS])


def export_lines(df: DataFrame) -> DataFrame:
    """Export rows joined by plain commas, null as empty, no quoting."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in EXPORT_COLUMNS]
    return export_columns(df).select(F.concat_ws(",", *cells).alias("line"))
