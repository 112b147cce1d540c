"""Single files (one export, one statistics document) and the search index."""

import csv
import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import ledger, statistics
from landroll.sources import csv_export, search_index, statistics_json

CLAIMS = "id STRING, name STRING, village STRING, district STRING, state STRING, status STRING, claim_type STRING, created_at TIMESTAMP_NTZ"


def claims(spark, n, parts=6):
    day = dt.datetime(2024, 1, 1)
    made = [(str(i), f'n "{i}", x' if i % 3 else None, "v\nw" if i % 5 == 0 else "", "d", "s", "Pending", None, day + dt.timedelta(hours=i * 7 % n)) for i in range(n)]
    return spark.createDataFrame(made, CLAIMS).repartition(parts)


def test_one_export_file_has_one_header_and_all_rows_in_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many sorted parts as a large table has
    try:
        csv_export.write_export(claims(spark, 200), str(tmp_path / "export.csv"), single_file=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    text = (tmp_path / "export.csv").read_bytes().decode()
    lines = list(csv.reader(text.splitlines(keepends=True)))
    assert lines[0] == list(ledger.EXPORT_COLUMNS.values()) and lines.count(lines[0]) == 1 and "\r\n" in text
    stamps = [(line[-1], line[0]) for line in lines[1:]]
    assert len(stamps) == 200 and stamps == sorted(stamps, reverse=True)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["export.csv"]
    with pytest.raises(FileExistsError):
        csv_export.write_export(claims(spark, 2), str(tmp_path / "export.csv"), single_file=True)


def test_an_export_without_rows_has_its_header(spark, tmp_path):
    csv_export.write_export(claims(spark, 3).limit(0), str(tmp_path / "export.csv"), single_file=True)
    assert (tmp_path / "export.csv").read_text().strip() == ",".join(ledger.EXPORT_COLUMNS.values())


def long_table(spark):
    made = [("b", 2, 1.0, "X", 5.0), ("b", 10, None, 'Y "q"', None), ("a", 1, None, "Z\nz", 1.3e7), ("b", 3, 2.0, "W", 0.5)]
    frame = spark.createDataFrame(made, "sheet_id STRING, row_pos BIGINT, slNo DOUBLE, state STRING, claimsReceivedTotal DOUBLE")
    others = [F.lit(None).cast("double").alias(m) for m in statistics.MEASURES if m != "claimsReceivedTotal"]
    listed = spark.createDataFrame(
        [("b", "B", dt.date(2024, 6, 30), 3), ("none", "none", None, 1), ("a", "a", None, 7)], "sheet_id STRING, label STRING, as_of DATE, period_order INT"
    )
    return frame.select("*", *others), listed


def test_one_document_has_all_periods_in_order(spark, tmp_path):
    table, listed = long_table(spark)
    path = str(tmp_path / "stats.json")
    statistics_json.write_document(table, path, 'the "book"', listed)
    said = json.loads((tmp_path / "stats.json").read_text())
    assert said["source"] == 'the "book"'
    assert [(p["id"], p["label"], p["asOf"], [r["state"] for r in p["rows"]]) for p in said["periods"]] == [
        ("none", "none", None, []), ("b", "B", "2024-06-30", ["X", "W", 'Y "q"']), ("a", "a", None, ["Z\nz"]),
    ]
    assert said["periods"][1]["rows"][0] == {"slNo": 1.0, "state": "X", "claimsReceivedTotal": 5.0}
    back = statistics_json.read_statistics(spark, path, single_document=True)
    assert rows(back.select("sheet_id", "as_of", "slNo", "state", "claimsReceivedTotal"), "period_order", "row_pos") == [
        ("b", dt.date(2024, 6, 30), 1.0, "X", 5.0), ("b", dt.date(2024, 6, 30), 2.0, "W", 0.5), ("b", dt.date(2024, 6, 30), None, 'Y "q"', None), ("a", None, None, "Z\nz", 1.3e7),
    ]
    statistics_json.write_document(table, str(tmp_path / "empty.json"), "x", listed.limit(0))
    assert json.loads((tmp_path / "empty.json").read_text()) == {"source": "x", "periods": []}


# ---- search index --------------------------------------------------------------------------------

FOUND = "id STRING, name STRING, village STRING, district STRING"


@pytest.fixture(scope="module")
def ledger_rows(spark):
    made = [(str(i), f"Claimant {i}", f"Village {i % 7}", ["Nagpur", "GADCHIROLI", "Été", None][i % 4]) for i in range(300)]
    made += [("x1", None, None, None), ("x2", "", "ab", "cd"), ("x3", "100%_done", "ÀÉÎ", "abc\nabd"), ("x4", "abc", "dab", "c"), ("x4", "abc", "twice", "c")]
    return spark.createDataFrame(made, FOUND).cache()


@pytest.fixture(scope="module")
def index(spark, ledger_rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("search"))
    search_index.write_index(ledger_rows, root)
    return root


@pytest.mark.parametrize("term", ["", "a", "vi", "vil", "Claimant 12", "GADCHIROLI", "gadchi", "été", "àéî", "%_d", "100%", "abc", "dabc", "bcd", "zzz", "claimant 1zz", "c\na", " 6"])
def test_the_index_finds_what_the_plain_search_finds(spark, ledger_rows, index, term):
    plain = rows(ledger.search(ledger_rows, term), "id", "village")
    assert rows(search_index.indexed_search(ledger_rows, index, term), "id", "village") == plain


def test_only_claims_with_the_grams_are_tested(spark, ledger_rows, index):
    ids = search_index.find_ids(spark, index, "Claimant 12")
    assert {r["id"] for r in ids.collect()} <= {r["id"] for r in ledger_rows.collect() if "12" in (r["name"] or "")}
    assert search_index.find_ids(spark, index, "zzz").count() == 0 and search_index.find_ids(spark, index, "ab") is None
    plan = search_index.indexed_search(ledger_rows, index, "Claimant 12")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "EqualTo(gram," in plan and "CartesianProduct" not in plan


def test_an_index_of_nothing(spark, ledger_rows, tmp_path):
    search_index.write_index(ledger_rows.limit(0), str(tmp_path))
    assert search_index.indexed_search(ledger_rows.limit(0), str(tmp_path), "abc").count() == 0
