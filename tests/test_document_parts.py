"""A statistics document in part files, written and read by many tasks."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_single_files import long_table

from landroll.operators import statistics
from landroll.plans import queries
from landroll.sources import statistics_json

COLUMNS = ("source", "period_order", "sheet_id", "label", "as_of", "row_pos", "slNo", "state", *statistics.MEASURES)


@pytest.fixture
def uncoalesced(spark):
    """As many sorted parts as a large table has."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def parts_of(path):
    return sorted(path.glob("part-*"))


def wide_table(spark):
    """One period of 400 rows, many of few or none, states that need escapes."""
    listed = spark.range(60).select(
        F.format_string('p"%d', "id").alias("sheet_id"), F.when(F.col("id") % 7 != 2, F.format_string("L\n%d", "id")).alias("label"),
        F.when(F.col("id") % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))).alias("as_of"),
        (F.lit(200) - F.col("id")).cast("int").alias("period_order"), "id",
    )
    n_rows = F.when(F.col("id") == 20, 400).otherwise(F.col("id") % 4)
    places = listed.where(n_rows > 0).select("sheet_id", "id", F.explode(F.sequence(F.lit(1), n_rows.cast("int"))).alias("nth"))
    others = [F.lit(None).cast("double").alias(m) for m in statistics.MEASURES[1:]]
    table = places.select(
        "sheet_id", (F.col("nth") * 10).cast("bigint").alias("row_pos"), F.when(F.col("nth") % 5 != 0, F.col("nth").cast("double")).alias("slNo"),
        F.format_string('"rows": [\r\n ]},{"id":%d-%d "', "id", "nth").alias("state"), (F.col("id") + F.col("nth") / 8).alias(statistics.MEASURES[0]), *others,
    )
    return table, listed.drop("id")


@pytest.mark.parametrize("lines_per_run", [1, 7, 50_000])
def test_parts_are_the_document_and_read_as_its_rows(spark, tmp_path, uncoalesced, lines_per_run):
    table, listed = wide_table(spark)
    statistics_json.write_document(table, str(tmp_path / "one.json"), 'the "book"', listed)
    statistics_json.write_document(table, str(tmp_path / "parts.json"), 'the "book"', listed, single_file=False)
    parts = parts_of(tmp_path / "parts.json")
    text = (tmp_path / "one.json").read_bytes()
    assert len(parts) > 4 and b"".join(p.read_bytes() for p in parts) == text
    assert max(p.stat().st_size for p in parts) < len(text) / 3
    assert len(json.loads(text)["periods"]) == 60
    plain = rows(statistics_json.read_statistics(spark, str(tmp_path / "one.json"), single_document=True).select(*COLUMNS), "period_order", "row_pos")
    assert len(plain) == table.count() > 400
    back = statistics_json.read_document(spark, str(tmp_path / "parts.json"), lines_per_run=lines_per_run)
    assert [(f.name, f.dataType) for f in back.schema] == [
        (f.name, f.dataType) for f in statistics_json.read_statistics(spark, str(tmp_path / "one.json"), single_document=True).schema
    ]
    assert rows(back.select(*COLUMNS), "period_order", "row_pos") == plain


def test_one_file_is_read_in_blocks(spark, tmp_path):
    table, listed = wide_table(spark)
    path = str(tmp_path / "one.json")
    statistics_json.write_document(table, path, "book", listed)
    plain = rows(statistics_json.read_statistics(spark, path, single_document=True).select(*COLUMNS), "period_order", "row_pos")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        back = statistics_json.read_document(spark, path)
        assert rows(back.select(*COLUMNS), "period_order", "row_pos") == plain
    finally:
        spark.conf.set(key, before)


def test_documents_without_rows(spark, tmp_path):
    table, listed = long_table(spark)
    for name, periods in {"none": listed.limit(0), "empty": listed.where("sheet_id = 'none'")}.items():
        path = tmp_path / f"{name}.json"
        statistics_json.write_document(table, str(path), "x", periods, single_file=False)
        said = json.loads("".join(p.read_text() for p in parts_of(path)))
        assert (said["source"], [p["id"] for p in said["periods"]]) == ("x", [r["sheet_id"] for r in periods.collect()])
        assert statistics_json.read_document(spark, str(path)).count() == 0


@pytest.mark.parametrize("text", [
    '{\n "source": "x",\n "periods": []\n}', '{"source": "x", "periods": [{"id": "a", "rows": [{"state": "Z"}]}]}', '{"state":"Z"}\n',
    '{"source": "x", "periods": [\n{"id":"a","label":"a","asOf":null, "rows": [\n{"state":"Z",}\n]}\n]}',
])
def test_other_layouts_are_an_error(spark, tmp_path, text):
    (tmp_path / "other.json").write_text(text)
    with pytest.raises(Exception, match="(?i)no line of a statistics document|a row before the first period|malformed"):
        statistics_json.read_document(spark, str(tmp_path / "other.json")).collect()


def test_the_query_writes_its_document_in_parts(spark, folder, tmp_path, monkeypatch, uncoalesced):
    monkeypatch.setattr(queries, "work_folder", lambda spark, name: str(tmp_path / name))
    queries.QUERIES["stats_json_document"](spark, folder)
    parts = parts_of(tmp_path / "statistics.json")
    sizes = [p.stat().st_size for p in parts]
    assert len(parts) > 4 and max(sizes) < sum(sizes) / 3
    assert json.loads("".join(p.read_text() for p in parts))["source"] == queries.SOURCE
