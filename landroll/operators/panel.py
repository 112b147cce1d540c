"""Panel queries on the long statistics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landroll.functions.numbers import indian_number, percent_text
from landroll.operators.ordering import with_positions

# The highlighted states, and how many states the chart shows.
FOCUS_STATES = ("Madhya Pradesh", "Tripura", "Odisha", "Telangana")
TOP_STATES = 10
CLAIMS = "claimsReceivedTotal"
TITLES = "titlesDistributedTotal"


def measure_sum(measure: str) -> Column:
    """Sum of the numbers in a column, 0 when there are none."""
    return F.coalesce(F.sum(measure), F.lit(0.0))


def _of_all(found: DataFrame, periods: DataFrame | None, period: str, absent: dict[str, float | int | bool]) -> DataFrame:
    """The figures of every listed period; those without rows get the given ones."""
    if periods is None:
        return found
    every = periods.select(period).distinct().join(found, period, "left")
    return every.fillna({c: v for c, v in absent.items()})


def sum_field(df: DataFrame, measure: str, periods: DataFrame | None = None, *, period: str = "sheet_id") -> DataFrame:
    """Sum of a measure per period; `periods` lists those to show, also without rows."""
    found = df.groupBy(period).agg(measure_sum(measure).alias("total"))
    return _of_all(found, periods, period, {"total": 0.0})


def period_kpis(df: DataFrame, periods: DataFrame | None = None, *, period: str = "sheet_id") -> DataFrame:
    """Claims, titles, states and title rate per period, as numbers and as display text.

    `periods` lists the periods to show; one without rows has 0, 0, 0 and no rate.
    """
    found = df.groupBy(period).agg(
        measure_sum(CLAIMS).alias("claims"),
        measure_sum(TITLES).alias("titles"),
        F.count("*").alias("states"),
    )
    sums = _of_all(found, periods, period, {"claims": 0.0, "titles": 0.0, "states": 0})
    rate = F.when(F.col("claims") > 0, F.col("titles") / F.col("claims") * 100)
    return sums.withColumn("rate", rate).withColumns(
        {
            "claims_text": indian_number("claims"),
            "titles_text": indian_number("titles"),
            "states_text": indian_number("states"),
            "rate_text": percent_text("rate"),
        }
    )


def available_measures(df: DataFrame, periods: DataFrame | None = None, *, period: str = "sheet_id") -> DataFrame:
    """Which optional measures a period has at all; a listed period without rows has none."""
    pending = F.col("pendingIndividual").isNotNull() | F.col("pendingCommunity").isNotNull()
    found = df.groupBy(period).agg(
        F.bool_or(F.col("rejectedTotal").isNotNull()).alias("has_rejected"),
        F.bool_or(pending).alias("has_pending"),
        F.bool_or(F.col("forestLandTotal").isNotNull()).alias("has_forest_land"),
    )
    return _of_all(found, periods, period, {"has_rejected": False, "has_pending": False, "has_forest_land": False})


def load_summary(df: DataFrame, periods: DataFrame) -> DataFrame:
    """State rows over all periods, and how many periods there are (also those without rows)."""
    marks = df.select(F.lit(1).alias("row"), F.lit(0).alias("period"))
    marks = marks.unionByName(periods.select(F.lit(0).alias("row"), F.lit(1).alias("period")))
    return marks.agg(
        F.coalesce(F.sum("row"), F.lit(0)).alias("state_rows"),
        F.coalesce(F.sum("period"), F.lit(0)).alias("periods"),
    )


def default_direction(key: str, *, current: tuple[str, str] | None = None) -> str:
    """Direction after choosing a sort key: the same key flips, a new one starts at its default."""
    if current and current[0] == key:
        return "desc" if current[1] == "asc" else "asc"
    return "asc" if key == "state" else "desc"


def sort_order(df: DataFrame, key: str, direction: str | None = None, *, row_pos: str = "row_pos") -> list[Column]:
    """Sort columns: text by Unicode collation with null as empty, numbers with null lowest; stable."""
    ascending = (direction or default_direction(key)) == "asc"
    if isinstance(df.schema[key].dataType, T.StringType):
        value = F.collate(F.coalesce(F.col(key), F.lit("")), "UNICODE")
    else:
        value = F.col(key)
    first = value.asc_nulls_first() if ascending else value.desc_nulls_last()
    return [first, F.asc(row_pos)]


def sort_rows(
    df: DataFrame, key: str = CLAIMS, direction: str | None = None, *, period: str = "sheet_id"
) -> DataFrame:
    """Rows of each period in display order (a range-partitioned sort)."""
    return df.orderBy(period, *sort_order(df, key, direction))


def with_rank(
    df: DataFrame,
    key: str = CLAIMS,
    direction: str | None = None,
    *,
    rank: str = "rank_pos",
    period: str = "sheet_id",
) -> DataFrame:
    """Add the 1-based place of each row in the display order of its period."""
    return with_positions(df, sort_order(df, key, direction), rank, within=(period,))


def top_states(df: DataFrame, n: int = TOP_STATES) -> DataFrame:
    """The states with most claims received, a missing number counting as 0."""
    claims = F.coalesce(CLAIMS, F.lit(0.0)).alias("claims")
    titles = F.coalesce(TITLES, F.lit(0.0)).alias("titles")
    chosen = df.select("sheet_id", "row_pos", "state", claims, titles)
    return chosen.orderBy(F.desc("claims"), "row_pos", "sheet_id").limit(n)


def with_focus_flag(df: DataFrame, states: tuple[str, ...] = FOCUS_STATES) -> DataFrame:
    return df.withColumn("is_focus", F.coalesce(F.col("state").isin(*states), F.lit(False)))


def choose_periods(periods: DataFrame, wanted: tuple[str, ...], *, period: str = "sheet_id") -> DataFrame:
    """(wanted, period): each wanted period, or the first one where there is no such one. One row per wanted id."""
    ids = F.explode(F.array(*[F.lit(w) for w in wanted])).alias("wanted")
    place = F.struct(F.col(period) != F.col("wanted"), "period_order", period)
    return periods.select(period, "period_order", ids).groupBy("wanted").agg(F.min_by(period, place).alias(period))


def pick_periods(
    df: DataFrame, periods: DataFrame, wanted: tuple[str, ...], *, period: str = "sheet_id"
) -> DataFrame:
    """Rows of each wanted period, or of the first period where there is no such one.

    `periods` is the period list `(period, period_order)`. The choice has one row per wanted id, so
    its broadcast has a known size. Where the rows have yet to be parsed, `choose_periods` first tells which to read.
    """
    return df.join(F.broadcast(choose_periods(periods, wanted, period=period)), period)


def table_rows(df: DataFrame, *, period: str = "sheet_id") -> DataFrame:
    """Display text of the panel table; a column the period does not have is null."""
    shown = [
        CLAIMS, "claimsReceivedIndividual", "claimsReceivedCommunity",
        TITLES, "titlesDistributedIndividual", "titlesDistributedCommunity",
        "pendingIndividual", "pendingCommunity", "rejectedTotal", "forestLandTotal",
    ]
    texts = F.transform(F.array(*shown), indian_number).alias("_texts")
    rows = df.select(period, "row_pos", "state", texts).join(available_measures(df, period=period), period)

    def text(measure: str) -> Column:
        return F.get("_texts", F.lit(shown.index(measure)))

    def parts(stem: str) -> Column:
        return F.concat(F.lit("I "), text(stem + "Individual"), F.lit(" · C "), text(stem + "Community"))

    pending = F.concat(text("pendingIndividual"), F.lit(" / "), text("pendingCommunity"))
    return rows.select(
        period,
        "row_pos",
        "state",
        text(CLAIMS).alias("claims_text"),
        parts("claimsReceived").alias("claims_parts"),
        text(TITLES).alias("titles_text"),
        parts("titlesDistributed").alias("titles_parts"),
        F.when(F.col("has_pending"), pending).alias("pending_text"),
        F.when(F.col("has_rejected"), text("rejectedTotal")).alias("rejected_text"),
        F.when(F.col("has_forest_land"), text("forestLandTotal")).alias("forest_land_text"),
    )
