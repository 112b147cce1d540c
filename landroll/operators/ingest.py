"""Batch intake: validation, duplicate rejection, status changes.

Copies of one text may be a large share of a batch or of the ledger. Texts are therefore reduced to
one small row per distinct text on the map side, before anything is shuffled; full rows are only
ever joined on their unique arrival number.

A batch is mostly small beside the ledger. Its size is measured, and a small one is sent to the
ledger scan so that the ledger is filtered where it is read instead of being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.functions.numbers import parse_plain_number
from landroll.functions.text import has_text
from landroll.operators.sizes import ROW_OVERHEAD, is_small, keep_wanted, text_bytes

TEXT_KEY_BYTES = 32

# Reject reasons.
NAME_REQUIRED = "Claimant name is required."
ALREADY_SAVED = "This document has already been processed and saved."
STATUS_REQUIRED = "Status is required"
CLAIM_NOT_FOUND = "Claim not found"

# Fixed value: the fields that are stored; anything else in a submission is left behind.
STORED_FIELDS = {
    "name": "string",
    "village": "string",
    "district": "string",
    "state": "string",
    "claim_type": "string",
    "status": "string",
    "latitude": "double",
    "longitude": "double",
    "raw_text": "string",
    "entities": "string",
}


def text_key(c: str) -> Column:
    """SHA-256 of a text, 32 bytes: stands for text equality in shuffles."""
    return F.unhex(F.sha2(F.col(c), 256))


def _first_arrivals(df: DataFrame, arrival: str, raw_text: str) -> DataFrame:
    """(text_key, first arrival) per distinct non-empty text."""
    keyed = df.where(has_text(raw_text)).select(arrival, text_key(raw_text).alias("text_key"))
    return keyed.groupBy("text_key").agg(F.min(arrival).alias("first_arrival"))


def first_wins(df: DataFrame, *, arrival: str = "arrival", raw_text: str = "raw_text") -> DataFrame:
    """The first row, by arrival, of each non-empty text."""
    first = _first_arrivals(df, arrival, raw_text).select(F.col("first_arrival").alias(arrival))
    return df.join(first, arrival, "left_semi")


def screen_claims(
    batch: DataFrame,
    ledger: DataFrame,
    *,
    arrival: str = "arrival",
    name: str = "name",
    raw_text: str = "raw_text",
    ledger_text: str = "raw_text",
    ledger_key: str | None = None,
    ledger_buckets: int | None = None,
) -> DataFrame:
    """Add `reject_reason` (null = accepted) to each row of a batch of new claims.

    `arrival` is unique and orders the batch. A claim without a name is rejected before its text is
    looked at, so it cannot shadow a later one. Of the named claims with equal non-empty text the
    first is accepted, unless the ledger already holds the text. `ledger_key` names a ledger column
    with stored text keys, which spares reading the ledger's texts. `ledger_buckets` tells that these are
    bucketed by key: the batch's keys are then dealt into as many parts, and the ledger's stay where they are.
    """
    if ledger_key:
        known = ledger.where(F.col(ledger_key).isNotNull()).select(F.col(ledger_key).alias("text_key"))
    else:
        known = ledger.where(has_text(ledger_text)).select(text_key(ledger_text).alias("text_key"))
    named = has_text(name)
    firsts = _first_arrivals(batch.where(named), arrival, raw_text)
    if ledger_buckets:
        dealt = firsts.repartition(ledger_buckets, "text_key")  # grouped once more, or the join below would move under it
        firsts = dealt.groupBy("text_key").agg(F.min("first_arrival").alias("first_arrival"))
    batch_rows = batch.count()
    known = keep_wanted(known, firsts, "text_key", batch_rows * (TEXT_KEY_BYTES + ROW_OVERHEAD))
    fresh = firsts.join(known.distinct(), "text_key", "left_anti").select(
        F.col("first_arrival").alias("_fresh")
    )
    if is_small(batch_rows * ROW_OVERHEAD):  # the outcomes then meet the batch where it is, and no text moves
        fresh = F.broadcast(fresh)
    reason = F.when(~named, NAME_REQUIRED).when(
        has_text(raw_text) & F.col("_fresh").isNull(), ALREADY_SAVED
    )
    joined = batch.join(fresh, F.col(arrival) == F.col("_fresh"), "left")
    return joined.withColumn("reject_reason", reason).drop("_fresh")


def accepted(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reject_reason").isNull()).drop("reject_reason")


def duplicates(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reject_reason") == ALREADY_SAVED)


def name_rejects(df: DataFrame, *, name: str = "name") -> DataFrame:
    """Submissions without a claimant name, with the reason."""
    return df.where(~has_text(name)).withColumn("reject_reason", F.lit(NAME_REQUIRED))


def _as_stored(c: str, kind: str, found: str | None) -> Column:
    if found is None:
        return F.lit(None).cast(kind)
    if kind == "double" and found == "string":
        return parse_plain_number(c)
    if kind == "string" and found.startswith(("struct", "array", "map")):
        return F.to_json(c)
    return F.col(c).cast(kind)


def stored_rows(df: DataFrame, created_at: Column | None = None, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the stored fields plus `created_at`; fields a submission lacks become null.

    Every field gets its stored type, so batches of other types can be appended to one ledger: text
    that is no plain number is no coordinate, and nested entities are stored as JSON.
    """
    kinds = dict(df.dtypes)
    fields = [_as_stored(c, kind, kinds.get(c)).alias(c) for c, kind in STORED_FIELDS.items()]
    stamp = F.current_timestamp() if created_at is None else created_at
    return df.select(*keep, *fields, stamp.alias("created_at"))


def latest_status(
    updates: DataFrame,
    *,
    claim_id: str = "claim_id",
    status: str = "status",
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """The last non-empty status per claim; each task sends one row per claim."""
    last = F.max_by(status, F.struct(*order)).alias(status)
    return updates.where(has_text(status)).groupBy(claim_id).agg(last)


def apply_status(
    claims: DataFrame,
    updates: DataFrame,
    *,
    id_col: str = "id",
    status: str = "status",
    claim_id: str = "claim_id",
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """Claims with the last status change applied; both join sides have one row per claim."""
    latest = latest_status(updates, claim_id=claim_id, status=status, order=order)
    latest = latest.select(F.col(claim_id).alias(id_col), F.col(status).alias("_new"))
    if is_small(text_bytes(updates, [claim_id, status])):
        latest = F.broadcast(latest)
    columns = [F.coalesce("_new", status).alias(c) if c == status else F.col(c) for c in claims.columns]
    return claims.join(latest, id_col, "left").select(*columns)


def status_rejects(
    claims: DataFrame,
    updates: DataFrame,
    *,
    id_col: str = "id",
    status: str = "status",
    claim_id: str = "claim_id",
) -> DataFrame:
    """Status changes that cannot be applied, with the reason.

    Changes without a status never reach the join. A claim with very many changes makes one join
    partition large; it is on the left of an anti join, where the adaptive planner may split it, and
    the other side has one row per claim.
    """
    empty = updates.where(~has_text(status)).withColumn("reject_reason", F.lit(STATUS_REQUIRED))
    filled = updates.where(has_text(status))
    ids = claims.select(F.col(id_col).alias(claim_id))
    ids = keep_wanted(ids, filled.select(claim_id).distinct(), claim_id, text_bytes(updates, [claim_id]))
    unknown = filled.join(ids, claim_id, "left_anti").withColumn("reject_reason", F.lit(CLAIM_NOT_FOUND))
    return empty.unionByName(unknown)
