import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import documents
from landroll.sources import csv_export
from landroll.sources import documents as files

FORM = "\n".join(
    [
        "Forest Rights Act Claim Form", "Name of Claimant: Ramesh Kumar", "Village: Bhimapur", "District: Gadchiroli",
        "State: Maharashtra", "Claim Type: IFR", "Status: Approved", "Coordinates: 20.1234, 79.1234",
    ]
)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id INT, raw_text STRING")


def test_golden_form(spark):
    found = documents.form_coordinates(documents.form_fields(texts(spark, FORM))).first()
    names = ("name", "village", "district", "state", "claim_type", "status", "latitude", "longitude")
    assert [found[n] for n in names] == [
        "Ramesh Kumar", "Bhimapur", "Gadchiroli", "Maharashtra", "IFR", "Approved", "20.1234", "79.1234",
    ]
    assert json.loads(documents.form_json(texts(spark, FORM)).first()["json"]) == {
        "claimant_info": {"name": "Ramesh Kumar", "village": "Bhimapur", "district": "Gadchiroli", "state": "Maharashtra"},
        "claim_details": {"type": "IFR", "status": "Approved"},
        "geographical_info": {"coordinates": {"latitude": "20.1234", "longitude": "79.1234"}},
        "raw_text": FORM,
    }


def test_field_edges(spark):
    df = documents.form_fields(
        texts(spark, "Village:\n\nDistrict: X", "statement of facts", "Village- V7 \r\nSTATE:  Goa ", "Village:  ", "nothing")
    )
    found = df.orderBy("doc_id").collect()
    assert (found[0]["village"], found[0]["district"]) == ("District: X", "X")
    assert found[1]["state"] == "ment of facts"
    assert (found[2]["village"], found[2]["state"]) == ("V7", "Goa")
    assert found[3]["village"] == ""  # the label is there, its value is blank
    assert found[4]["village"] is None


def test_missing_fields_are_written_as_null(spark, tmp_path):
    path = str(tmp_path / "forms")
    files.write_forms(texts(spark, "nothing here"), path)
    written = json.loads(spark.read.text(path).first()[0])
    assert written["claimant_info"] == {"name": None, "village": None, "district": None, "state": None}
    assert written["geographical_info"] == {"coordinates": {"latitude": None, "longitude": None}}


def test_land_areas(spark):
    df = documents.land_areas(texts(spark, "2.5 hectares and 3 ACRES", "1acre, 10.25  Hectare", "no land", "१२ acres"))
    found = df.orderBy("doc_id").collect()
    assert [r["land_area"] for r in found] == [
        ["2.5 .5 hectares", "3  ACRES"], ["1  acre", "10.25 .25 Hectare"], [], ["१२  acres"],
    ]
    assert [(a["value"], a["unit"]) for a in found[1]["areas"]] == [(1.0, "acre"), (10.25, "hectare")]


def test_area_in_a_long_text_is_found_wherever_it_is(spark):
    df = documents.land_areas(texts(spark, "word " * 50_000 + "7 acres"))
    assert df.first()["land_area"] == ["7  acres"]


def test_extensions(spark):
    names = ["a.PDF", "dir.x/b.tar.Png", ".bashrc", "..c.jpg", "noext", "d.", "x/y.exe", "", None, "/p/.hid/f.jpeg"]
    df = spark.createDataFrame(list(enumerate(names)), "i INT, path STRING")
    found = documents.screen_files(df).orderBy("i").collect()
    assert [r["extension"] for r in found] == [".pdf", ".png", "", ".jpg", "", ".", ".exe", "", None, ".jpeg"]
    ok, bad, none = None, documents.INVALID_TYPE, documents.NO_FILE
    assert [r["reject_reason"] for r in found] == [ok, ok, bad, ok, bad, bad, bad, none, none, ok]


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "scan.JPG").write_bytes(b"123")
    (tmp_path / "notes.txt").write_text("x")
    found = {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert found == {"scan.JPG": None, "notes.txt": documents.INVALID_TYPE}
    contents = files.read_contents(spark, str(tmp_path)).collect()
    assert [bytes(r["content"]) for r in contents] == [b"123"]


PAGES = "doc_id INT, page_no INT, text STRING"


def test_page_assembly(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 10, "c"), (2, 1, None)], PAGES)
    assert rows(documents.assemble_text(pages), "doc_id") == [(1, "a\nb\nc\n"), (2, "\n")]
    assert rows(documents.assemble_text(pages, page_end=""), "doc_id") == [(1, "abc"), (2, "")]


def test_the_size_of_parts_does_not_show(spark):
    words = ["Village:", "Bhima", "District:", "Kandhamal"]
    pages = spark.range(1000).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.get(F.array(*[F.lit(w) for w in words]), (F.col("id") % 4).cast("int")).alias("text"))
    whole = rows(documents.form_fields(documents.assemble_text(pages, pages_per_part=1000)))
    assert len(whole) == 1 and whole[0][1].startswith("Village:\nBhima\n")
    spans = pages.select("doc_id", F.col("page_no").alias("pos"), F.lit("GPE").alias("label"), F.col("page_no").cast("string").alias("text"))
    buckets = rows(documents.entity_buckets(spans, positions_per_part=1000))
    for size in (1, 7, 999, 1001):
        assert rows(documents.form_fields(documents.assemble_text(pages, pages_per_part=size))) == whole
        assert rows(documents.entity_buckets(spans, positions_per_part=size)) == buckets


def test_choice_of_text(spark):
    df = spark.createDataFrame(
        [(1, "a", None, "f"), (2, " \n", None, "f"), (3, None, "boom", "f"), (4, "a", "boom", "\t"), (5, None, None, "f")],
        "doc_id INT, primary_text STRING, primary_error STRING, fallback_text STRING",
    )
    chosen = documents.choose_text(df).select("raw_text", "reject_reason")
    gone = (None, documents.NO_TEXT)
    assert rows(chosen, "doc_id") == [("a", None), gone, ("f", None), gone, gone]


SPANS = "doc_id INT, pos INT, label STRING, text STRING"


def test_entities_and_places(spark):
    spans = spark.createDataFrame(
        [
            (1, 9, "PERSON", "Second"), (1, 2, "PERSON", "First"), (1, 3, "GPE", "INDIA"), (1, 5, "LOC", "Bhimapur"),
            (1, 4, "GPE", "village"), (1, 7, "GPE", "Gadchiroli"), (1, 8, "GPE", "Nagpur"), (1, 1, "DATE", "May"),
            (2, 1, "ORG", "Office"), (3, 1, "GPE", "Only"),
        ],
        SPANS,
    )
    buckets = documents.entity_buckets(spans)
    first = buckets.where("doc_id = 1").first()
    assert first["persons"] == ["First", "Second"]
    assert first["locations"] == ["INDIA", "village", "Bhimapur", "Gadchiroli", "Nagpur"]
    assert (first["dates"], first["organizations"]) == (["May"], [])
    expected = [(1, "First", "Bhimapur", "Gadchiroli"), (2, None, None, None), (3, None, "Only", None)]
    assert rows(documents.places_from_spans(spans), "doc_id") == expected
    resolved = documents.resolve_places(buckets).select("doc_id", "name", "village", "district")
    assert rows(resolved, "doc_id") == expected


def test_review_and_summary(spark):
    df = spark.createDataFrame([("Ann", None, "")], "name STRING, village STRING, raw_text STRING")
    assert documents.review_prefill(df).first().asDict() == {
        "name": "Ann", "village": "", "district": "", "state": "", "claim_type": "Individual", "status": "Pending",
        "latitude": "", "longitude": "", "raw_text": "",
    }
    summary = documents.extraction_summary(df.withColumn("district", F.lit("")))
    assert summary.first().asDict() == {
        "name": "Ann", "village": "Not found", "district": "Not found", "raw_text": "No text extracted.",
    }


def test_csv_export(spark, tmp_path):
    df = spark.sql(
        "SELECT id, name, CAST(NULL AS STRING) village, '' district, 'S' state, 'Pending' status, 'IFR' claim_type,"
        " TIMESTAMP_NTZ '2024-01-02 03:04:05' + make_dt_interval(id) created_at"
        " FROM VALUES (1, 'plain'), (2, 'with, comma'), (3, 'with \"quote\"') t(id, name)"
    )
    csv_export.write_export(df.coalesce(1), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    body = b"".join(p.read_bytes() for p in parts).decode()
    header = "ID,Name,Village,District,State,Status,Claim Type,Created At\r\n"
    lines = body.replace(header, "").split("\r\n")
    assert body.startswith(header)
    assert lines == [
        '3,"with ""quote""",,,S,Pending,IFR,2024-01-05T03:04:05.000000+00:00',
        '2,"with, comma",,,S,Pending,IFR,2024-01-04T03:04:05.000000+00:00',
        "1,plain,,,S,Pending,IFR,2024-01-03T03:04:05.000000+00:00",
        "",
    ]


def extraction(spark, pages, spans, **more):
    pages = spark.createDataFrame(pages, "doc_id INT, page_no INT, text STRING")
    spans = spark.createDataFrame(spans, "doc_id INT, pos INT, label STRING, text STRING")
    return {r["doc_id"]: r for r in documents.document_extraction(pages, spans, **more).collect()}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_extraction_record(spark, size):
    pages = [(1, 2, "then 3 acres"), (1, 0, "first 2.5 Hectares"), (1, 1, None), (2, 0, " \n"), (4, 0, "plain")]
    spans = [
        (1, 9, "GPE", "Bhimapur"), (1, 1, "PERSON", "Asha"), (1, 5, "LOC", "India"), (1, 3, "GPE", "District"), (1, 12, "LOC", "Gadchiroli"), (1, 4, "PERSON", "Ravi"),
        (1, 2, "DATE", "1999"), (1, 2, "ORG", "Board"), (1, 0, "CARDINAL", "three"), (3, 0, "ORG", "Office"), (3, 1, "GPE", None),
    ]
    found = extraction(spark, pages, spans, positions_per_part=size)
    assert sorted(found) == [1, 2, 3, 4]
    one = found[1]
    assert one["raw_text"] == "first 2.5 Hectares\n\nthen 3 acres\n" and one["reject_reason"] is None
    assert (one["name"], one["village"], one["district"]) == ("Asha", "Bhimapur", "Gadchiroli")
    assert (one["persons"], one["locations"]) == (["Asha", "Ravi"], ["District", "India", "Bhimapur", "Gadchiroli"])
    assert (one["dates"], one["organizations"], one["land_area"]) == (["1999"], ["Board"], ["2.5 .5 Hectares", "3  acres"])
    assert one["entities"].asDict() == {c: one[c] for c in ("persons", "locations", "dates", "organizations", "land_area")}
    assert found[2]["raw_text"] is found[3]["raw_text"] is None and found[2]["reject_reason"] == found[3]["reject_reason"] == documents.NO_TEXT
    assert found[2]["persons"] == [] and found[2]["land_area"] == [] and found[3]["organizations"] == ["Office"]
    assert found[4]["name"] is None and found[4]["raw_text"] == "plain\n"


def test_extraction_equals_the_jobs_by_themselves(spark):
    pages = [(i % 7, i, f"page {i} has {i}.5 acres") for i in range(60)]
    spans = [(i % 5, i, ("PERSON", "GPE", "LOC", "DATE", "ORG")[i * i % 5], f"t{i}" if i % 4 else "India") for i in range(80)]
    found = extraction(spark, pages, spans, positions_per_part=4)
    texts = documents.assemble_text(spark.createDataFrame(pages, "doc_id INT, page_no INT, text STRING"))
    assert {r["doc_id"]: r["raw_text"] for r in texts.collect()} == {i: r["raw_text"] for i, r in found.items()}
    frame = spark.createDataFrame(spans, "doc_id INT, pos INT, label STRING, text STRING")
    for r in documents.entity_buckets(frame).collect():
        assert all(found[r["doc_id"]][c] == r[c] for c in documents.ENTITY_BUCKETS)
    for r in documents.places_from_spans(frame).collect():
        assert all(found[r["doc_id"]][c] == r[c] for c in ("name", "village", "district"))


def test_extraction_has_one_exchange_on_the_document(spark):
    pages = spark.createDataFrame([], "doc_id INT, page_no INT, text STRING")
    spans = spark.createDataFrame([], "doc_id INT, pos INT, label STRING, text STRING")
    plan = documents.document_extraction(pages, spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # the runs, then the documents
    assert "Join" not in plan and documents.document_extraction(pages, spans).count() == 0


def test_extraction_feeds_review_and_intake(spark):
    from landroll.operators import ingest

    pages = spark.createDataFrame([(1, 0, "text of 3 acres")], "doc_id INT, page_no INT, text STRING")
    spans = spark.createDataFrame([(1, 0, "PERSON", "Asha")], "doc_id INT, pos INT, label STRING, text STRING")
    record = documents.document_extraction(pages, spans)
    assert documents.review_prefill(record.select("doc_id", "name", "village", "raw_text")).first()["name"] == "Asha"
    stored = ingest.stored_rows(record, keep=("doc_id",)).first()
    assert stored["entities"] == '{"persons":["Asha"],"locations":[],"dates":[],"organizations":[],"land_area":["3  acres"]}'
