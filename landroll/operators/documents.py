"""Document jobs: file screening, page assembly, field extraction, entities and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landroll.functions.text import as_column, first_group, has_text, or_default, trim_ws

# Accepted file types, and the reasons for turning a file or a document away.
ALLOWED_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff")
NO_FILE = "No selected file"
INVALID_TYPE = "Invalid file type."
NO_TEXT = "Failed to extract any text from the document."

# Patterns of the labelled form. Flags: ignore case, `.` stops at line feeds only,
# Unicode classes.
FLAGS = "(?iudU)"
FIELD_PATTERNS = {
    "name": FLAGS + r"Name\s*of\s*Claimant[:\-]?\s*(.+)",
    "village": FLAGS + r"Village[:\-]?\s*(.+)",
    "district": FLAGS + r"District[:\-]?\s*(.+)",
    "state": FLAGS + r"State[:\-]?\s*(.+)",
    "claim_type": FLAGS + r"Claim\s*Type[:\-]?\s*(.+)",
    "status": FLAGS + r"Status[:\-]?\s*(.+)",
}
COORDINATE_PATTERN = FLAGS + r"Coordinates[:\-]?\s*([\d\.-]+)\s*,\s*([\d\.-]+)"
AREA_PATTERN = FLAGS + r"(\d+(\.\d+)?)\s*(hectares|hectare|acres|acre)"

# Entity labels per bucket, and words that name no particular place.
ENTITY_BUCKETS = {
    "persons": ("PERSON",),
    "locations": ("GPE", "LOC"),
    "dates": ("DATE",),
    "organizations": ("ORG",),
}
GENERIC_PLACES = ("india", "state", "district", "village")

# Fields of the review form, and review and summary defaults.
REVIEW_FIELDS = (
    "name", "village", "district", "state", "claim_type", "status", "latitude", "longitude", "raw_text",
)
REVIEW_TYPE = "Individual"
REVIEW_STATUS = "Pending"
NOT_FOUND = "Not found"
NO_TEXT_SHOWN = "No text extracted."

# Pages or entity positions of a document that are sorted together before the sorted parts are merged.
POSITIONS_PER_PART = 1_000


def file_extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; names that only start with dots have none."""
    return F.lower(F.regexp_extract(as_column(path), r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1))


def screen_files(
    df: DataFrame, *, path: str = "path", allowed: tuple[str, ...] = ALLOWED_EXTENSIONS
) -> DataFrame:
    """Add `extension` and `reject_reason` (null = accepted)."""
    extension = file_extension(path)
    reason = F.when(~has_text(path), NO_FILE).when(~extension.isin(*allowed), INVALID_TYPE)
    return df.withColumns({"extension": extension, "reject_reason": reason})


def _part(position: str, per_part: int) -> Column:
    return F.floor(F.col(position) / per_part).alias("part_no")


def assemble_text(
    pages: DataFrame,
    *,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
    page_end: str = "\n",
    pages_per_part: int = POSITIONS_PER_PART,
) -> DataFrame:
    """Page texts of a document in page order, each followed by `page_end`: one row per document.

    `page_end` is empty for single images. Runs of `pages_per_part` pages are sorted and joined
    first, in tasks of their own, then the runs of a document are put together; the size of a run
    does not show in the result.
    """
    placed = F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text"))))
    ended = F.transform(placed, lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit(page_end)))
    parts = pages.groupBy(doc, _part(page, pages_per_part)).agg(F.array_join(ended, "").alias("_text"))
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "_text")))
    return parts.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p["_text"]), "").alias("raw_text"))


def choose_text(
    df: DataFrame,
    *,
    primary: str = "primary_text",
    error: str = "primary_error",
    fallback: str = "fallback_text",
) -> DataFrame:
    """Add `raw_text` and `reject_reason`: the primary text, or the fallback where the primary failed.

    A primary result that is only blank is final: no text, no fallback.
    """
    text = F.when(F.col(error).isNull(), F.col(primary)).otherwise(F.col(fallback))
    blank = F.coalesce(trim_ws(text) == "", F.lit(True))
    return df.withColumns(
        {"raw_text": F.when(~blank, text), "reject_reason": F.when(blank, NO_TEXT)}
    )


def form_fields(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Add the labelled fields of a form; null where a label does not occur."""
    return df.withColumns({field: first_group(text, pattern) for field, pattern in FIELD_PATTERNS.items()})


def form_coordinates(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Add `latitude` and `longitude` as the text found."""
    return df.withColumns(
        {
            "latitude": first_group(text, COORDINATE_PATTERN, 1),
            "longitude": first_group(text, COORDINATE_PATTERN, 2),
        }
    )


def digitised_form(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Fields and coordinates as nested objects."""
    found = form_coordinates(form_fields(df, text=text), text=text)
    others = [c for c in df.columns if c != text]
    return found.select(
        *others,
        F.struct("name", "village", "district", "state").alias("claimant_info"),
        F.struct(F.col("claim_type").alias("type"), "status").alias("claim_details"),
        F.struct(F.struct("latitude", "longitude").alias("coordinates")).alias("geographical_info"),
        F.col(text).alias("raw_text"),
    )


def form_json(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Each digitised form as JSON text, missing fields written as null."""
    nested = digitised_form(df, text=text)
    form = ["claimant_info", "claim_details", "geographical_info", "raw_text"]
    others = [c for c in nested.columns if c not in form]
    return nested.select(*others, F.to_json(F.struct(*form), {"ignoreNullFields": "false"}).alias("json"))


def land_areas(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Add `land_area` (number, its fraction and unit joined by spaces) and `areas` (value, unit).

    The long text is scanned once; the groups are read from the short matches.
    """
    def group(match: Column, n: int) -> Column:
        return F.regexp_extract(match, AREA_PATTERN, n)

    matches = F.col("_matches")
    joined = F.transform(matches, lambda m: F.concat_ws(" ", group(m, 1), group(m, 2), group(m, 3)))
    clean = F.transform(
        matches,
        lambda m: F.struct(
            group(m, 1).try_cast("double").alias("value"), F.lower(group(m, 3)).alias("unit")
        ),
    )
    found = df.withColumn("_matches", F.regexp_extract_all(F.col(text), F.lit(AREA_PATTERN), F.lit(0)))
    return found.withColumns({"land_area": joined, "areas": clean}).drop("_matches")


def entity_buckets(
    spans: DataFrame,
    *,
    doc: str = "doc_id",
    position: str = "pos",
    label: str = "label",
    text: str = "text",
    positions_per_part: int = POSITIONS_PER_PART,
) -> DataFrame:
    """Entity texts per document and bucket, in text order: one row per document.

    As with pages, runs of `positions_per_part` positions are sorted first and then put together.
    """
    span = F.struct(F.col(position).alias("pos"), F.col(text).alias("text"), F.col(label).alias("label"))
    placed = F.sort_array(F.collect_list(span)).alias("_spans")

    def bucket(labels: tuple[str, ...]) -> Column:
        chosen = F.filter("_spans", lambda s: s["label"].isin(*labels))
        return F.transform(chosen, lambda s: s["text"])

    parts = spans.groupBy(doc, _part(position, positions_per_part)).agg(placed)
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "_spans")))
    merged = parts.groupBy(doc).agg(F.flatten(F.transform(ordered, lambda p: p["_spans"])).alias("_spans"))
    return merged.select(doc, *[bucket(labels).alias(name) for name, labels in ENTITY_BUCKETS.items()])


def document_extraction(
    pages: DataFrame,
    spans: DataFrame,
    *,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
    position: str = "pos",
    label: str = "label",
    page_end: str = "\n",
    positions_per_part: int = POSITIONS_PER_PART,
) -> DataFrame:
    """One record per document from its page texts and its entity spans.

    Columns: doc, raw_text, reject_reason, the entity lists, land_area, name, village, district, and `entities`, the lists and
    areas as the object that a claim stores. A document without spans has empty lists; one without pages, or with blank
    ones, has no text and says so in reject_reason.

    Pages and spans go through one exchange on the document together: runs of `positions_per_part` positions are sorted in
    tasks of their own, then the runs of a document are put in order.
    """
    own = pages.select(
        F.col(doc), F.lit(0).alias("_kind"), F.col(page).cast("bigint").alias("_at"), F.col(text).alias("_text"), F.lit(None).cast("string").alias("_label")
    )
    found = spans.select(F.col(doc), F.lit(1).alias("_kind"), F.col(position).cast("bigint").alias("_at"), F.col(text).alias("_text"), F.col(label).alias("_label"))
    item = F.struct(F.col("_kind").alias("kind"), F.col("_at").alias("at"), F.col("_text").alias("text"), F.col("_label").alias("label"))
    parts = own.union(found).groupBy(doc, "_kind", _part("_at", positions_per_part)).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    runs = F.sort_array(F.collect_list(F.struct("_kind", "part_no", "_items")))
    merged = parts.groupBy(doc).agg(F.flatten(F.transform(runs, lambda r: r["_items"])).alias("_items"))

    ended = F.transform(F.filter("_items", lambda i: i["kind"] == 0), lambda i: F.concat(F.coalesce(i["text"], F.lit("")), F.lit(page_end)))

    def bucket(labels: tuple[str, ...]) -> Column:
        return F.transform(F.filter("_items", lambda i: i["label"].isin(*labels)), lambda i: i["text"])

    whole = F.array_join(ended, "")
    rows = merged.select(
        doc, F.when(trim_ws(whole) != "", whole).alias("raw_text"), *[bucket(labels).alias(name) for name, labels in ENTITY_BUCKETS.items()]
    )
    rows = resolve_places(land_areas(rows).drop("areas"))
    rows = rows.withColumn("land_area", F.coalesce("land_area", F.array().cast("array<string>")))
    return rows.withColumns(
        {"reject_reason": F.when(F.col("raw_text").isNull(), NO_TEXT), "entities": F.struct(*ENTITY_BUCKETS, "land_area")}
    )


def _is_particular(text: Column) -> Column:
    return ~F.lower(text).isin(*GENERIC_PLACES)


def resolve_places(df: DataFrame, *, persons: str = "persons", locations: str = "locations") -> DataFrame:
    """Add `name`, `village`, `district` from entity arrays."""
    places = F.filter(locations, _is_particular)
    return df.withColumns(
        {"name": F.get(persons, F.lit(0)), "village": F.get(places, F.lit(0)), "district": F.get(places, F.lit(1))}
    )


def places_from_spans(
    spans: DataFrame,
    *,
    doc: str = "doc_id",
    position: str = "pos",
    label: str = "label",
    text: str = "text",
) -> DataFrame:
    """`name`, `village`, `district` of each document straight from its spans.

    Name is the first person, village and district the first two locations that are no generic
    word. Only the first two of each kind can matter, and every task drops the rest before the
    shuffle, so a document with very many spans is no hot spot.
    """
    person = F.col(label).isin(*ENTITY_BUCKETS["persons"])
    place = F.col(label).isin(*ENTITY_BUCKETS["locations"]) & _is_particular(F.col(text))
    kind = F.when(person, "person").when(place, "place").otherwise("other")
    rank = F.row_number().over(Window.partitionBy(doc, "kind").orderBy(position, text))
    first = spans.withColumn("kind", kind).withColumn("rank", rank).where(F.col("rank") <= 2)

    def pick(wanted: str, n: int) -> Column:
        return F.max(F.when((F.col("kind") == wanted) & (F.col("rank") == n), F.col(text)))

    return first.groupBy(doc).agg(
        pick("person", 1).alias("name"), pick("place", 1).alias("village"), pick("place", 2).alias("district")
    )


def review_prefill(df: DataFrame) -> DataFrame:
    """Form values for a review: what was found, else empty; type and status at their defaults."""
    others = [c for c in df.columns if c not in REVIEW_FIELDS]

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")

    values = {c: value(c) for c in REVIEW_FIELDS}
    values["claim_type"], values["status"] = F.lit(REVIEW_TYPE), F.lit(REVIEW_STATUS)
    return df.select(*others, *[v.alias(c) for c, v in values.items()])


def extraction_summary(df: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Key details with defaults for what was not found."""
    details = ("name", "village", "district")
    others = [c for c in df.columns if c not in details and c != text]
    return df.select(
        *others,
        *[or_default(c, NOT_FOUND).alias(c) for c in details],
        or_default(text, NO_TEXT_SHOWN).alias("raw_text"),
    )
