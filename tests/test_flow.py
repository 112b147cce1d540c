"""The jobs put together: pages of forms become ledger rows, changes and figures."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import analytics, documents, ingest, ledger, maplayer
from landroll.sources import documents as files
from landroll.sources import tables


def form(name, village, where):
    return [f"Name of Claimant: {name}\nVillage: {village}", f"State: Odisha\nCoordinates: {where}\nArea 3 acres"]


def test_from_pages_to_figures(spark, tmp_path):
    docs = {
        1: form("Ramesh Kumar", "Bhimapur", "20.1234, 79.1234"),
        2: form("Ramesh Kumar", "Bhimapur", "20.1234, 79.1234"),  # the same document again
        3: form("Sita Devi", "Kalimela", "0, 79.5"),
        4: ["no labels at all", ""],
        5: [" ", "\n"],
    }
    pages = [(d, p, text) for d, texts in docs.items() for p, text in enumerate(texts)]
    texts = documents.assemble_text(spark.createDataFrame(pages, "doc_id BIGINT, page_no INT, text STRING"))
    outputs = texts.select(
        "doc_id", F.col("raw_text").alias("primary_text"),
        F.lit(None).cast("string").alias("primary_error"), F.lit("unused").alias("fallback_text"),
    )
    chosen = documents.choose_text(outputs).where("reject_reason IS NULL").select(F.col("doc_id").alias("arrival"), "raw_text")
    filled = documents.review_prefill(documents.form_coordinates(documents.form_fields(chosen)))
    batch = ledger.coerce_coordinates(filled, latitude="latitude", longitude="longitude")

    path = str(tmp_path / "ledger")
    empty = spark.createDataFrame([], "raw_text STRING")
    screened = ingest.screen_claims(batch, empty)
    assert rows(screened.select("arrival", "reject_reason"), "arrival") == [
        (1, None), (2, ingest.ALREADY_SAVED), (3, None), (4, ingest.NAME_REQUIRED),
    ]
    stamp = F.to_timestamp_ntz(F.format_string("2024-01-%02d 00:00:00", "arrival"))
    tables.append_claims(ingest.accepted(screened), path, created_at=stamp, new_id=F.col("arrival").cast("string"))

    claims = spark.read.parquet(path)
    again = ingest.screen_claims(batch, claims, ledger_key="text_key")
    assert ingest.accepted(again).count() == 0

    changes = spark.createDataFrame([(1, "1", "Approved", 1), (2, "8", "Approved", 2)], "event_id INT, claim_id STRING, status STRING, ts INT")
    updated = ingest.apply_status(claims, changes)
    assert rows(analytics.approval_rate(ledger.listed(updated))) == [(2, 1, 50.0, "50.0")]
    assert rows(analytics.cumulative_by_day(updated)) == [(dt.date(2024, 1, 1), 1, 1), (dt.date(2024, 1, 3), 1, 2)]
    assert [r["id"] for r in maplayer.valid_points(updated).collect()] == ["1"]
    assert [r["name"] for r in ledger.list_claims(updated).collect()] == ["Sita Devi", "Ramesh Kumar"]


def test_glob_takes_any_case():
    assert files.any_case_glob((".pdf", ".x1")) == "{*.[pP][dD][fF],*.[xX]1}"
