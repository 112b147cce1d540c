import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import ingest, sizes
from landroll.sources import tables

BATCH = "arrival BIGINT, name STRING, raw_text STRING"


def batch(spark, *claims):
    return spark.createDataFrame(list(claims), BATCH)


def reasons(df):
    return {r["arrival"]: r["reject_reason"] for r in df.collect()}


def test_screening(spark):
    new = batch(
        spark,
        (1, None, "text a"),  # no name: rejected, and does not shadow row 2
        (2, "Ann", "text a"),
        (3, "Bob", "text a"),  # copy of row 2
        (4, "Cid", "known"),  # already in the ledger
        (5, "Dan", ""), (6, "Eve", ""), (7, "Fay", None),  # empty texts are never duplicates
        (8, "", "text b"),
        (9, "Gus", "Text a"),  # equality is exact
    )
    ledger = spark.createDataFrame([("known",), ("",), (None,)], "raw_text STRING")
    screened = ingest.screen_claims(new, ledger)
    name, saved = ingest.NAME_REQUIRED, ingest.ALREADY_SAVED
    assert reasons(screened) == {1: name, 2: None, 3: saved, 4: saved, 5: None, 6: None, 7: None, 8: name, 9: None}
    assert rows(ingest.accepted(screened).select("arrival"), "arrival") == [(2,), (5,), (6,), (7,), (9,)]
    assert rows(ingest.duplicates(screened).select("arrival"), "arrival") == [(3,), (4,)]
    assert rows(ingest.name_rejects(new).select("arrival"), "arrival") == [(1,), (8,)]


def test_screening_against_brute_force_with_a_hot_text(spark):
    """A third of the batch and of the ledger is one text."""
    texts = ["hot" if i % 3 == 0 else f"t{i % 50}" if i % 3 == 1 else None for i in range(3000)]
    new = batch(spark, *[(i, "n" if i % 11 else None, t) for i, t in enumerate(texts)])
    held = spark.createDataFrame([(t,) for t in ["t3", "t7", "t9"] * 500], "raw_text STRING")
    seen, expected = {"t3", "t7", "t9"}, {}
    for i, t in enumerate(texts):
        if not i % 11:
            expected[i] = ingest.NAME_REQUIRED
        elif t and t in seen:
            expected[i] = ingest.ALREADY_SAVED
        else:
            expected[i] = None
            if t:
                seen.add(t)
    assert reasons(ingest.screen_claims(new, held)) == expected


def test_first_wins(spark):
    df = batch(spark, (5, "x", "a"), (2, "y", "a"), (9, "z", "b"), (1, "w", ""), (3, "v", None))
    assert rows(ingest.first_wins(df).select("arrival"), "arrival") == [(2,), (9,)]


def test_stored_rows(spark):
    df = spark.createDataFrame([(1, "Ann", 3.5, "junk")], "arrival BIGINT, name STRING, latitude DOUBLE, extra STRING")
    stored = ingest.stored_rows(df, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert stored.columns == [*ingest.STORED_FIELDS, "created_at"]
    assert len(stored.columns) == 11
    row = stored.first()
    assert (row["name"], row["latitude"], row["village"], row["created_at"]) == ("Ann", 3.5, None, dt.datetime(2024, 1, 1))


def test_append_then_screen_by_stored_key(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = batch(spark, (1, "Ann", "a"), (2, "Bob", None))
    tables.append_claims(first, path)
    ledger = spark.read.parquet(path)
    assert ledger.columns == ["id", *ingest.STORED_FIELDS, "created_at", "text_key"]
    assert len({r["id"] for r in ledger.collect()}) == 2
    second = batch(spark, (3, "Cid", "a"), (4, "Dan", "b"))
    screened = ingest.screen_claims(second, ledger, ledger_key="text_key")
    assert reasons(screened) == {3: ingest.ALREADY_SAVED, 4: None}
    scans = [line for line in plan_of(screened).splitlines() if "FileScan" in line]
    assert scans and all("raw_text" not in line for line in scans)
    tables.append_claims(ingest.accepted(screened), path)
    assert spark.read.parquet(path).count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


UPDATES = "event_id BIGINT, claim_id STRING, status STRING, ts INT"


def test_status_changes(spark):
    claims = spark.createDataFrame([("1", "Pending"), ("2", None), ("3", "Approved")], "id STRING, status STRING")
    updates = spark.createDataFrame(
        [
            (1, "1", "Approved", 10), (2, "1", "Rejected", 20), (3, "1", "", 30), (4, "2", "Anything", 5),
            (5, "2", "In Review", 5), (6, "9", "Approved", 1), (7, "9", None, 2),
        ],
        UPDATES,
    )
    assert rows(ingest.latest_status(updates), "claim_id") == [("1", "Rejected"), ("2", "In Review"), ("9", "Approved")]
    assert rows(ingest.apply_status(claims, updates), "id") == [("1", "Rejected"), ("2", "In Review"), ("3", "Approved")]
    rejects = ingest.status_rejects(claims, updates).select("event_id", "reject_reason")
    assert rows(rejects, "event_id") == [
        (3, ingest.STATUS_REQUIRED), (6, ingest.CLAIM_NOT_FOUND), (7, ingest.STATUS_REQUIRED),
    ]


def test_changes_with_a_hot_claim_are_split_at_run_time(spark, monkeypatch):
    """A third of the changes is for one unknown claim, and neither side may be broadcast."""
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", -1)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        updates = spark.range(600_000).select(
            F.col("id").alias("event_id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5000).cast("string")).alias("claim_id"),
            F.when(F.col("id") % 10 != 0, "Approved").otherwise("").alias("status"),
        )
        claims = spark.range(4000).select(F.col("id").cast("string").alias("id"))
        rejects = ingest.status_rejects(claims, updates)
        counts = rows(rejects.groupBy("reject_reason").count(), "reject_reason")
        rejects._jdf.queryExecution().toRdd().count()
        assert "SortMergeJoin(skew=true)" in plan_of(rejects)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    expected = {ingest.CLAIM_NOT_FOUND: 0, ingest.STATUS_REQUIRED: 0}
    for i in range(600_000):
        if i % 10 == 0:
            expected[ingest.STATUS_REQUIRED] += 1
        elif i % 3 == 0 or i % 5000 >= 4000:
            expected[ingest.CLAIM_NOT_FOUND] += 1
    assert counts == sorted(expected.items())


def test_small_and_large_batches_give_the_same_result(spark, folder, monkeypatch):
    from landroll.plans.queries import QUERIES

    names = ["ingest_dedup", "ingest_duplicates", "status_apply", "status_update_rejects"]
    small = {n: sorted(map(str, QUERIES[n](spark, folder).collect())) for n in names}
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", -1)
    assert {n: sorted(map(str, QUERIES[n](spark, folder).collect())) for n in names} == small


def test_measured_bytes(spark):
    df = spark.createDataFrame([("ab", None), ("é", "x")], "a STRING, b STRING")
    assert sizes.text_bytes(df, ["a", "b"]) == 2 * sizes.ROW_OVERHEAD + 5
    assert sizes.text_bytes(df.limit(0), ["a"]) == 0
