import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import analytics, ledger, maplayer

SCHEMA = (
    "id STRING, name STRING, village STRING, district STRING, state STRING, claim_type STRING, status STRING,"
    " latitude_in STRING, longitude_in STRING, raw_text STRING, created_at TIMESTAMP_NTZ"
)


def claim(id_, created="2024-01-01T00:00:00", **fields):
    names = ["name", "village", "district", "state", "claim_type", "status", "latitude_in", "longitude_in", "raw_text"]
    at = dt.datetime.fromisoformat(created) if created else None
    return (id_, *[fields.get(n) for n in names], at)


def table(spark, *claims):
    return spark.createDataFrame(list(claims), SCHEMA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_listing_is_newest_first_and_leaves_out_undated(spark):
    df = table(spark, claim("a"), claim("c"), claim("b", "2024-02-01"), claim("x", None))
    assert ids(ledger.list_claims(df)) == ["b", "c", "a"]


def test_search_takes_the_term_literally(spark):
    df = table(spark, claim("1", name="100% Ann"), claim("2", village="Bhimapur"), claim("3", district=None))
    assert ids(ledger.search(df, "%")) == ["1"]
    assert ids(ledger.search(df, "BHIMA")) == ["2"]
    assert ids(ledger.search(df, "_")) == []
    assert len(ids(ledger.search(df, ""))) == 3


def test_facets_are_exact_and_empty_choices_filter_nothing(spark):
    df = table(spark, claim("1", state="Odisha", status="Approved"), claim("2", state="odisha"), claim("3"))
    assert ids(ledger.facet_filter(df, state="Odisha", status="", district=None)) == ["1"]
    assert len(ids(ledger.facet_filter(df, state=""))) == 3


def test_ledger_after_default_status(spark):
    df = ledger.default_status(table(spark, claim("1", status=""), claim("2"), claim("3", status="In Review")))
    assert rows(df.select("id", "status"), "id") == [("1", "Pending"), ("2", "Pending"), ("3", "In Review")]
    assert ids(ledger.facet_filter(df, status="Pending")) == ["1", "2"]


def test_facets_before_and_after_the_default_agree(spark):
    df = table(spark, claim("1", status=""), claim("2"), claim("3", status="Pending"), claim("4", status="Approved"))
    for status in ("Pending", "Approved", "Rejected", ""):
        before = ledger.default_status(ledger.facet_filter(df, status=status))
        after = ledger.facet_filter(ledger.default_status(df), status=status, missing={})
        assert rows(before.select("id", "status"), "id") == rows(after.select("id", "status"), "id")
    assert ids(ledger.facet_filter(df, status="Pending", missing={})) == ["3"]


def test_rows_and_details(spark):
    df = ledger.coerce_coordinates(
        table(
            spark,
            claim("1234567890abc", name="", district="D", state=""),
            claim("2", village="V", latitude_in="8.0", longitude_in="77.25", raw_text="text"),
            claim("3", latitude_in="0", longitude_in="abc"),
            claim("4", latitude_in="", longitude_in="1"),
        )
    )
    first = rows(ledger.ledger_rows(df), "id")[0]
    assert first == ("1234567890abc", "Unnamed claimant", "#12345678", "Village N/A", "D", "Individual", "Pending")
    details = {r["id"]: r for r in ledger.detail_rows(df).collect()}
    assert details["1234567890abc"]["title"] == "Claim record"
    assert details["1234567890abc"]["short_id"] == "#1234567890"
    assert details["2"]["subtitle"] == "V"
    assert details["2"]["coordinates"] == "8, 77.25"
    assert details["2"]["raw_text"] == "text"
    assert details["3"]["coordinates"] == "0, abc"
    assert details["3"]["subtitle"] == "Location not recorded"
    assert details["4"]["coordinates"] == "—"
    assert details["4"]["raw_text"] == "No raw text available for this claim."


def test_facet_values_in_first_seen_order(spark):
    df = table(
        spark,
        claim("1", "2024-01-01", state="A"), claim("2", "2024-01-03", state="B"), claim("3", "2024-01-02", state="C"),
        claim("4", "2024-01-03", state="C"), claim("5", "2024-01-09", state=""), claim("6", "2024-01-09"),
    )
    assert [r["value"] for r in ledger.facet_values(df, "state").collect()] == ["C", "B", "A"]


def test_pages(spark):
    df = table(spark, *[claim(f"{i:03d}", f"2024-01-{1 + i % 7:02d}") for i in range(25)])
    everything = ids(ledger.list_claims(df))
    assert [ids(ledger.ledger_page(df, p)) for p in (1, 2, 3, 4)] == [everything[:10], everything[10:20], everything[20:], []]
    assert rows(ledger.page_count(df)) == [(25, 3)]
    assert rows(ledger.page_count(df.limit(0))) == [(0, 0)]


def test_sparse_and_serialized_json(spark):
    df = table(spark, claim("1", "2024-05-06T07:08:09", name="Ann"))
    text = ledger.sparse_json(ledger.serialized(df.select("created_at", "id", "name", "village"))).first()["json"]
    assert list(json.loads(text).items()) == [
        ("id", "1"), ("created_at", "2024-05-06T07:08:09.000000+00:00"), ("name", "Ann"),
    ]


def test_export_lines_do_not_quote(spark):
    df = table(spark, claim("1", name="A, B", state="S"))
    assert ledger.export_lines(df).first()["line"] == "1,A, B,,,S,,,2024-01-01T00:00:00.000000+00:00"


def test_the_three_readings_of_a_missing_status(spark):
    df = table(spark, claim("1"), claim("2", status=""), claim("3", status="Pending"), claim("4", status="In Review"))
    assert rows(analytics.dashboard_kpis(df)) == [(4, 1, 0)]
    assert rows(analytics.count_by(df, "status", missing="Pending"), "status") == [("In Review", 1), ("Pending", 3)]
    rollup = {(r["dimension"], r["value"]): r["n"] for r in analytics.count_rollup(df).collect()}
    assert rollup == {
        ("claim_type", "Unknown"): 4, ("district", "Unknown"): 4, ("status", "Pending"): 3, ("status", "In Review"): 1,
    }


def test_approval_rate(spark):
    one_of_16 = table(spark, *[claim(str(i), status="Approved" if i == 0 else None) for i in range(16)])
    assert rows(analytics.approval_rate(one_of_16)) == [(16, 1, 6.3, "6.3")]
    assert rows(analytics.approval_rate(one_of_16.limit(0))) == [(0, 0, 0.0, "0")]


def test_running_total(spark):
    df = table(spark, claim("1", "2024-01-02T23:59:59"), claim("2", "2024-01-01"), claim("3", "2024-01-02"), claim("4", None))
    assert rows(analytics.cumulative_by_day(df)) == [(dt.date(2024, 1, 1), 1, 1), (dt.date(2024, 1, 2), 2, 3)]


def test_map(spark):
    df = ledger.coerce_coordinates(
        table(
            spark,
            claim("1", latitude_in="20.5", longitude_in="79.25", claim_type="CR", name=""),
            claim("2", latitude_in="0", longitude_in="79"), claim("3", latitude_in="abc", longitude_in="79"),
            claim("4", latitude_in="", longitude_in="79"), claim("5", latitude_in="5d", longitude_in="79"),
        )
    )
    points = maplayer.valid_points(df)
    assert ids(points) == ["1"]
    assert maplayer.with_color(points).first()["color"] == "#198754"
    area = maplayer.with_area(points).first()["area"]
    assert [(round(c["lat"], 4), round(c["lon"], 4)) for c in area] == [
        (20.49, 79.24), (20.51, 79.24), (20.51, 79.26), (20.49, 79.26),
    ]
    assert maplayer.popups(points).first()[1:] == ("N/A", "N/A", "N/A", "CR", "N/A")
    colors = df.sparkSession.createDataFrame([("IFR",), ("CFR",), ("Individual",), (None,)], "claim_type STRING")
    assert [r[0] for r in colors.select(maplayer.claim_color()).collect()] == ["#0d6efd", "#ffc107", "#6c757d", "#6c757d"]
    assert df.where(F.col("id") == "3").first()["latitude_in"] == "abc"
