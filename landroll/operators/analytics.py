"""Claims analytics: key figures, group counts, daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landroll.functions.text import or_default
from landroll.functions.times import utc_day

# Labels for missing group values, and the two statuses that are counted by name.
UNKNOWN = "Unknown"
PENDING = "Pending"
APPROVED = "Approved"

# Group columns of the charts and the label a missing value gets.
CHART_GROUPS = {"claim_type": UNKNOWN, "status": PENDING, "district": UNKNOWN}


def dashboard_kpis(df: DataFrame, *, status: str = "status") -> DataFrame:
    """All claims, and those whose stored status is exactly Pending / Approved."""
    return df.agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col(status) == PENDING).alias("claims_in_review"),
        F.count_if(F.col(status) == APPROVED).alias("claims_approved"),
    )


def count_by(df: DataFrame, column: str, *, missing: str = UNKNOWN) -> DataFrame:
    """Claims per value, null and empty counted under `missing`."""
    return df.groupBy(or_default(column, missing).alias(column)).agg(F.count("*").alias("n"))


def count_rollup(df: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """The counts of several columns from one scan: (dimension, value, n).

    The rows are first counted per combination, so only the combinations, not the claims, are
    expanded into one row per dimension.
    """
    groups = groups or CHART_GROUPS
    labelled = df.select(*[or_default(c, missing).alias(c) for c, missing in groups.items()])
    combos = labelled.groupBy(*groups).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in groups])
    return (
        combos.select(F.inline(pairs), "n")
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("n"))
    )


def count_by_day(df: DataFrame, *, created_at: str = "created_at") -> DataFrame:
    """Claims per UTC calendar day; claims without a timestamp are left out."""
    return (
        df.where(F.col(created_at).isNotNull())
        .groupBy(utc_day(df, created_at).alias("day"))
        .agg(F.count("*").alias("n"))
    )


def cumulative_by_day(df: DataFrame, *, created_at: str = "created_at") -> DataFrame:
    """Running total over the days. The window sees one row per calendar day, never the claims."""
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = count_by_day(df, created_at=created_at)
    return daily.select("day", "n", F.sum("n").over(so_far).alias("running_total")).orderBy("day")


def approval_rate(df: DataFrame, *, status: str = "status") -> DataFrame:
    """Total, approved and the approval rate in percent (one decimal, 0 without claims)."""
    totals = df.agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col(status) == APPROVED).alias("approved_claims"),
    )
    rate = F.round(F.try_divide("approved_claims", "total_claims") * 100, 1)
    text = F.when(F.col("total_claims") > 0, F.format_string("%.1f", rate)).otherwise("0")
    return totals.select(
        "total_claims",
        "approved_claims",
        F.coalesce(rate, F.lit(0.0)).alias("approval_rate"),
        text.alias("approval_rate_text"),
    )
