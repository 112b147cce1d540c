"""Statistics workbook jobs: headers, dirty cells, totals, periods, nested form.

Input is a table of sheet rows `(sheet_id, row_pos, cells)`; row 0 of a sheet is its header. Cells are
ARRAY<STRING>, or ARRAY<STRUCT<text, number>> where the source tells numbers from text: a number then
counts as it is, and only text is cleaned. `header_rows` and `value_rows` take the table apart, and the jobs
work on these two. Everything but the lookup of a sheet's header is local to a row.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landroll.functions.numbers import parse_number
from landroll.functions.text import as_column, has_text, squeeze_ws, trim_ws

# Header texts of the two leading columns.
SERIAL_HEADERS = ("sl. no.", "s.no.", "s. no.", "sl no.", "sno")
STATE_HEADERS = ("state", "states", "states/ut", "state/ut")

# Phrase a header must contain, the key it leads to, and the parts it comes in. The
# part's own word must be in the header too. Earlier entries win.
MEASURE_PHRASES = (
    ("claims received", "claimsReceived", ("Individual", "Community", "Total")),
    ("titles distributed", "titlesDistributed", ("Individual", "Community", "Total")),
    ("pending claims", "pending", ("Individual", "Community")),
    ("claims rejected", "rejected", ("Individual", "Community", "Total")),
    ("forest land", "forestLand", ("Individual", "Community", "Total")),
)
MEASURES = tuple(key + part for _, key, parts in MEASURE_PHRASES for part in parts)

# The periods that are known by name, newest first, with label and as-of date.
KNOWN_PERIODS = {
    "June_2024": ("June 2024", "2024-06-30"),
    "OCT_2023": ("October 2023", "2023-10-31"),
    "NOV_2022": ("November 2022", "2022-11-30"),
    "May_2019": ("May 2019", "2019-05-31"),
}

# Fixed value: a row with this state, in any case, is a sum and not a state.
TOTAL_ROW = "total"

# Measures whose missing total is the sum of its parts.
SUMMED = ("claimsReceived", "titlesDistributed")

# Rows of a period that are sorted together before the sorted parts are merged.
ROWS_PER_PART = 5_000

ROW_TYPE = "STRUCT<slNo: DOUBLE, state: STRING, " + ", ".join(f"{m}: DOUBLE" for m in MEASURES) + ">"
PERIODS_TYPE = (
    "ARRAY<STRUCT<id: STRING, label: STRING, asOf: STRING, position: INT, "
    f"rows: ARRAY<{ROW_TYPE}>>>"
)


def normalize_header(c: Column | str) -> Column:
    """Lower case, trimmed, each run of whitespace (line breaks too) one space."""
    return squeeze_ws(F.lower(trim_ws(F.coalesce(as_column(c), F.lit("")))))


class HeaderRule(NamedTuple):
    """Leads a normalised header to a key: it is one of the needles (`exact`), or it contains all of them."""

    key: str
    needles: tuple[str, ...]
    exact: bool = False


#: The rules in order; the first that fits a header counts.
HEADER_RULES = (
    HeaderRule("slNo", SERIAL_HEADERS, exact=True),
    HeaderRule("state", STATE_HEADERS, exact=True),
    *(HeaderRule(key + part, (phrase, part.lower())) for phrase, key, parts in MEASURE_PHRASES for part in parts),
)
MOST_RULES = 1_000


def rules_from_table(table: DataFrame) -> tuple[HeaderRule, ...]:
    """Rules kept as data: rows (rule_order, key, needles ARRAY<STRING>, exact). They are constants of a job, so their number is checked."""
    found = table.orderBy("rule_order").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} header rules")
    return tuple(HeaderRule(r["key"], tuple(r["needles"]), bool(r["exact"])) for r in found)


def rules_table(spark: SparkSession, rules: tuple[HeaderRule, ...] = HEADER_RULES) -> DataFrame:
    """The rules as a table that `rules_from_table` reads."""
    rows = [(i, r.key, list(r.needles), r.exact) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order INT, key STRING, needles ARRAY<STRING>, exact BOOLEAN")


def measures_of(rules: tuple[HeaderRule, ...]) -> tuple[str, ...]:
    """Keys that stand for numbers, in the order of the rules."""
    return tuple(dict.fromkeys(r.key for r in rules if r.key not in ("slNo", "state")))


def header_key(normalized: Column, rules: tuple[HeaderRule, ...] = HEADER_RULES) -> Column:
    """Stable key of a normalised header, null when nothing matches: the first rule that fits."""
    if not rules:
        return F.lit(None).cast("string")
    table = F.array(
        *[F.struct(F.lit(r.key).alias("key"), F.array(*[F.lit(n) for n in r.needles]).alias("needles"), F.lit(r.exact).alias("exact")) for r in rules]
    )

    def fits(rule: Column) -> Column:
        inside = F.forall(rule["needles"], lambda needle: F.contains(normalized, needle))
        return F.when(rule["exact"], F.array_contains(rule["needles"], normalized)).otherwise(inside)

    return F.get(F.filter(table, fits), F.lit(0))["key"]


def _typed(sheets: DataFrame) -> bool:
    return isinstance(sheets.schema["cells"].dataType.elementType, T.StructType)


def cell_texts(sheets: DataFrame) -> Column:
    """The cells as text, also where they are typed."""
    return F.transform("cells", lambda c: c["text"]) if _typed(sheets) else F.col("cells")


def cell_number(cell: Column, typed: bool) -> Column:
    """The number in a cell: one that is a number already as it is, else what the text says."""
    return F.coalesce(cell["number"], parse_number(cell["text"])) if typed else parse_number(cell)


def header_rows(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("row_pos") == 0)


def value_rows(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("row_pos") > 0)


def header_map(headers: DataFrame, rules: tuple[HeaderRule, ...] = HEADER_RULES) -> DataFrame:
    """(sheet_id, idx, header, normalized, key) of every header cell."""
    cells = headers.select("sheet_id", F.posexplode(cell_texts(headers)).alias("idx", "header"))
    normalized = cells.withColumn("normalized", normalize_header("header"))
    return normalized.withColumn("key", header_key(F.col("normalized"), rules))


def nonblank_rows(values: DataFrame) -> DataFrame:
    """Rows with at least one cell that is more than whitespace."""
    return values.where(trim_ws(F.concat_ws("", cell_texts(values))) != "")


def sheet_keys(headers: DataFrame, rules: tuple[HeaderRule, ...] = HEADER_RULES) -> DataFrame:
    """(sheet_id, keys): the key of each header cell in column order, empty where there is none."""
    normalized = F.transform(cell_texts(headers), normalize_header)
    keys = F.transform(normalized, lambda header: F.coalesce(header_key(header, rules), F.lit("")))
    return headers.select("sheet_id", keys.alias("keys"))


def _places(keys: Column, wanted: list[str]) -> Column:
    """Index of the right-most column of each wanted key, null where there is none."""
    def place(key: Column) -> Column:
        from_right = F.array_position(F.reverse(keys), key)
        return F.when(from_right > 0, F.size(keys) - from_right).cast("int")

    return F.transform(F.array(*[F.lit(key) for key in wanted]), place)


def keyed_rows(values: DataFrame, headers: DataFrame, rules: tuple[HeaderRule, ...] = HEADER_RULES) -> DataFrame:
    """Non-blank rows with one column per key: (sheet_id, row_pos, state, slNo, measures).

    Where a key's cell is, is worked out once per sheet. Of two columns with one key the right-hand
    one counts, also when its cell is empty. Cells that a short row does not have are no columns of
    that row, so its places are looked up again among the columns it has. No row is exploded or
    regrouped: the only join attaches the places to the rows of their sheet. A sheet without headers
    is an error, also where its rows are only counted.

    The cells are parsed inside array expressions, which keeps the generated code of a wide row
    small enough for the JVM to compile.
    """
    wanted = ["state", "slNo", *measures_of(rules)]
    typed = _typed(values)
    sheet = sheet_keys(headers, rules).withColumn("_of_sheet", _places(F.col("keys"), wanted))
    short = F.size("cells") < F.size("keys")
    of_row = _places(F.slice("keys", F.lit(1), F.size("cells")), wanted)
    known = nonblank_rows(values).join(sheet, "sheet_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no header row in sheet "), F.col("sheet_id"))).cast("boolean")
    known = known.where(F.when(F.col("_of_sheet").isNull(), unknown).otherwise(F.lit(True)))
    rows = known.select("sheet_id", "row_pos", "cells", F.when(short, of_row).otherwise(F.col("_of_sheet")).alias("_places"))
    state = F.get("cells", F.get("_places", F.lit(0)))
    found = rows.select(
        "sheet_id",
        "row_pos",
        F.coalesce(trim_ws(state["text"] if typed else state), F.lit("")).alias("state"),
        F.transform("_places", lambda i: cell_number(F.get("cells", i), typed)).alias("_numbers"),
    )
    numbers = [F.get("_numbers", F.lit(i)).alias(key) for i, key in enumerate(wanted) if key != "state"]
    return found.select("sheet_id", "row_pos", "state", *numbers)


def state_rows(keyed: DataFrame) -> DataFrame:
    """Rows that name a state; sum rows are dropped."""
    return keyed.where(has_text("state") & (F.lower("state") != TOTAL_ROW))


def fill_totals(df: DataFrame) -> DataFrame:
    """Fill a missing claims or titles total from its parts, a missing part counting as 0."""
    filled = {}
    for stem in (s for s in SUMMED if {s + "Individual", s + "Community", s + "Total"} <= set(df.columns)):
        parts = [F.col(stem + "Individual"), F.col(stem + "Community")]
        total = reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in parts])
        any_part = parts[0].isNotNull() | parts[1].isNotNull()
        filled[stem + "Total"] = F.coalesce(F.col(stem + "Total"), F.when(any_part, total))
    return df.withColumns(filled) if filled else df


def _by_period(sheet_id: str, values: dict[str, str | int | None], otherwise: Column) -> Column:
    chosen = otherwise
    for period, value in values.items():
        chosen = F.when(F.col(sheet_id) == period, F.lit(value)).otherwise(chosen)
    return chosen


def with_period_meta(
    df: DataFrame,
    known: dict[str, tuple[str, str]] | None = None,
    *,
    sheet_id: str = "sheet_id",
) -> DataFrame:
    """Add `label` and `as_of`; a period that is not known is labelled by its id and has no date."""
    known = KNOWN_PERIODS if known is None else known
    labels = {period: label for period, (label, _) in known.items()}
    dates = {period: as_of for period, (_, as_of) in known.items()}
    return df.withColumns(
        {
            "label": _by_period(sheet_id, labels, F.col(sheet_id)),
            "as_of": _by_period(sheet_id, dates, F.lit(None)).cast("date"),
        }
    )


def with_period_order(
    df: DataFrame,
    workbook_position: Column | str,
    preferred: tuple[str, ...] = tuple(KNOWN_PERIODS),
    *,
    sheet_id: str = "sheet_id",
) -> DataFrame:
    """Add `period_order`: preferred periods in the given order, the others after, as in the workbook."""
    places = {period: place for place, period in enumerate(preferred)}
    rest = as_column(workbook_position) + len(preferred)
    return df.withColumn("period_order", _by_period(sheet_id, places, rest).cast("int"))


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """Sheets with different measures as one table; a measure a sheet lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def clean_statistics(
    values: DataFrame,
    headers: DataFrame,
    known: dict[str, tuple[str, str]] | None = None,
    preferred: tuple[str, ...] | None = None,
    *,
    workbook_position: Column | str,
    rules: tuple[HeaderRule, ...] = HEADER_RULES,
) -> DataFrame:
    """Raw sheets to the long table, one row per period and state."""
    known = KNOWN_PERIODS if known is None else known
    preferred = tuple(known) if preferred is None else preferred
    rows = with_period_meta(fill_totals(state_rows(keyed_rows(values, headers, rules))), known)
    return with_period_order(rows, workbook_position, preferred)


def nest_periods(
    df: DataFrame, source: str, periods: DataFrame | None = None, *, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """The long table as payload records `(source, periods[{id, label, asOf, rows[…]}])`, one per period.

    Rows are in `row_pos` order. Runs of `rows_per_part` rows are sorted first and then put together.
    `periods` (sheet_id, label, as_of, period_order) lists the periods to write, those without rows with an
    empty list; without it, there are those that have rows.
    """
    meta = ("label", "as_of", "period_order")
    row = F.struct("row_pos", F.struct("slNo", "state", *MEASURES).alias("row"))
    part = F.floor(F.col("row_pos") / rows_per_part).alias("part")
    keys = ("sheet_id",) if periods is not None else ("sheet_id", *meta)
    parts = df.groupBy(*keys, part).agg(F.sort_array(F.collect_list(row)).alias("placed"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "placed")))
    grouped = parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda p: p["placed"])).alias("placed"))
    if periods is not None:
        grouped = periods.select("sheet_id", *meta).join(grouped, "sheet_id", "left")
    period = F.struct(
        F.col("sheet_id").alias("id"),
        "label",
        F.col("as_of").cast("string").alias("asOf"),
        F.col("period_order").alias("position"),
        F.coalesce(F.transform("placed", lambda p: p["row"]), F.expr(f"cast(array() as ARRAY<{ROW_TYPE}>)")).alias("rows"),
    )
    return grouped.select(F.lit(source).alias("source"), F.array(period).alias("periods"))


def flatten_periods(nested: DataFrame) -> DataFrame:
    """Payload records back to the long table; `row_pos` counts the rows of a period in array order.

    Takes a single payload with all periods as well as records written by `nest_periods`.
    """
    periods = nested.select("source", F.posexplode("periods").alias("_place", "p"))
    rows = periods.select(
        "source",
        F.coalesce("p.position", "_place").alias("period_order"),
        F.col("p.id").alias("sheet_id"),
        F.col("p.label").alias("label"),
        F.col("p.asOf").cast("date").alias("as_of"),
        F.posexplode("p.rows").alias("row_pos", "row"),
    )
    return rows.select(
        "source",
        "period_order",
        "sheet_id",
        "label",
        "as_of",
        F.col("row_pos").cast("bigint").alias("row_pos"),
        "row.*",
    )
