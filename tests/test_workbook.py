"""Typed workbooks with a manifest, header rules as data, and statistics files."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import panel, statistics
from landroll.sources import statistics_json, workbook


def write(root, sheets, manifest=None):
    """sheets: name -> list of rows of cells, as plain files."""
    for name, lines in sheets.items():
        folder = root / "sheets" / f"sheet_id={name}"
        folder.mkdir(parents=True)
        (folder / "rows.json").write_text("".join(json.dumps({"row_pos": i, "cells": cells}) + "\n" for i, cells in enumerate(lines)))
    names = manifest or list(sheets)
    (root / "manifest.json").write_text("".join(json.dumps({"sheet_id": n, "position": i}) + "\n" for i, n in enumerate(names)))
    return str(root)


def keyed(spark, root, rules=statistics.HEADER_RULES, **more):
    read = workbook.read_workbook(spark, root, **more)
    return statistics.keyed_rows(statistics.value_rows(read), statistics.header_rows(read), rules)


HEADER = ["Sl. No.", "State", "Claims received total", "Titles distributed total"]


def test_numbers_pass_untouched_and_text_is_cleaned(spark, tmp_path):
    root = write(tmp_path, {"s": [HEADER, [1, "a", 1.3e7, "1.3E7"], [2, "b", "12,3*", -0.5], [3, "c", True, False], [4, 5, None, "NA"], [5.5, "d", 12345678901234567890, 1e300]]})
    found = keyed(spark, root).select("state", "slNo", "claimsReceivedTotal", "titlesDistributedTotal")
    assert rows(found, "row_pos") == [
        ("a", 1.0, 13_000_000.0, 1.37), ("b", 2.0, 123.0, -0.5), ("c", 3.0, 1.0, 0.0), ("5", 4.0, None, None), ("d", 5.5, 12345678901234567890.0, 1e300),
    ]


def test_a_short_row_loses_only_its_missing_columns(spark, tmp_path):
    header = ["State", "Titles distributed individual", "Claims received total", "Forest land for titles distributed individual"]
    root = write(tmp_path, {"s": [header, ["whole", 1, 2, 3], ["null at the end", 1, 2, None], ["short", 1, 2], ["shorter", 1], ["shortest"], [], ["longer", 1, 2, 3, 4, 5], [None, None, 0]]})
    found = keyed(spark, root).select("state", "titlesDistributedIndividual", "claimsReceivedTotal")
    assert rows(found, "row_pos") == [
        ("whole", 3.0, 2.0), ("null at the end", None, 2.0), ("short", 1.0, 2.0), ("shorter", 1.0, None), ("shortest", None, None), ("longer", 3.0, 2.0), ("", None, 0.0),
    ]


def test_positions_come_from_the_manifest(spark, tmp_path):
    root = write(tmp_path, {"zz": [HEADER, [1, "a", 5]], "June_2024": [HEADER], "aa": [HEADER, [1, "b", 7]]})
    manifest = workbook.read_manifest(spark, root)
    listed = workbook.workbook_periods(manifest)
    assert rows(listed.select("sheet_id", "period_order", "label"), "period_order") == [("June_2024", 0, "June 2024"), ("zz", 4, "zz"), ("aa", 6, "aa")]
    read = workbook.with_positions_of(workbook.check_workbook(manifest, workbook.read_workbook(spark, root)), manifest)
    assert rows(read.select("sheet_id", "position").distinct(), "position") == [("zz", 0), ("June_2024", 1), ("aa", 2)]
    table = statistics.fill_totals(statistics.state_rows(keyed(spark, root))).join(listed, "sheet_id")
    out = str(tmp_path / "out")
    statistics_json.write_statistics(table, out, "book", listed)
    written = spark.read.schema(statistics_json.PAYLOAD_TYPE).json(out).select(F.inline("periods"))
    assert rows(written.select("id", F.size("rows")), "position") == [("June_2024", 0), ("zz", 1), ("aa", 1)]
    shown = {r["sheet_id"]: r["claims"] for r in panel.period_kpis(table, listed).collect()}
    assert shown == {"June_2024": 0.0, "zz": 5.0, "aa": 7.0}


def test_reading_one_period_opens_one_folder(spark, tmp_path):
    root = write(tmp_path, {f"s{i}": [HEADER, [1, "a", i]] for i in range(5)})
    listed = workbook.workbook_periods(workbook.read_manifest(spark, root), {}, ())
    (choice,) = panel.choose_periods(listed, ("s3",)).collect()
    read = workbook.read_workbook(spark, root, (choice["sheet_id"],))
    assert [f.split("/")[-2] for f in read.inputFiles()] == ["sheet_id=s3"]
    assert rows(keyed(spark, root, sheets=("s3",)).select("sheet_id", "claimsReceivedTotal")) == [("s3", 3.0)]
    (first,) = panel.choose_periods(listed, ("none",)).collect()
    assert first["sheet_id"] == "s0"


@pytest.mark.parametrize("lines", [[], [["x"]]])
def test_sheets_without_header_are_found_in_the_manifest(spark, tmp_path, lines):
    root = write(tmp_path, {"good": [HEADER, [1, "a", 5]]}, ["good", "bad"])
    if lines:
        (tmp_path / "sheets" / "sheet_id=bad").mkdir()
        (tmp_path / "sheets" / "sheet_id=bad" / "rows.json").write_text('{"row_pos": 1, "cells": ["x"]}\n')
        with pytest.raises(Exception, match="no header row in sheet bad"):
            keyed(spark, root).count()  # counting alone must see it
    with pytest.raises(ValueError, match="sheet bad is empty"):
        workbook.check_workbook(workbook.read_manifest(spark, root), workbook.read_workbook(spark, root))


def test_a_broken_line_is_an_error(spark, tmp_path):
    root = write(tmp_path, {"s": [HEADER]})
    (tmp_path / "sheets" / "sheet_id=s" / "more.json").write_text('{"row_pos": 1, "cells": ["x"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        workbook.read_workbook(spark, root).collect()


def test_write_and_read_back(spark, tmp_path):
    cells = F.array(F.parse_json(F.lit('"State"')), F.parse_json(F.lit("1.5")), F.lit(None).cast("variant"))
    sheets = spark.range(3).select(F.concat(F.lit("s"), "id").alias("sheet_id"), F.lit(0).alias("row_pos"), cells.alias("cells"))
    root = str(tmp_path / "book")
    workbook.write_workbook(sheets, spark.range(4).select(F.concat(F.lit("s"), "id").alias("sheet_id"), F.col("id").cast("int").alias("position")), root)
    assert workbook.read_manifest(spark, root).count() == 4
    back = [(r["sheet_id"], [tuple(c) for c in r["cells"]]) for r in workbook.read_workbook(spark, root).collect()]
    assert sorted(back) == [(f"s{i}", [("State", None), ("1.5", 1.5), (None, None)]) for i in range(3)]


def test_files_do_not_grow_with_the_number_of_sheets(spark, tmp_path):
    sheets, parts = 300, 6
    cells = F.array(F.parse_json(F.col("id").cast("string")))
    table = spark.range(sheets * 2).repartition(parts).select(F.concat(F.lit("s/"), F.col("id") % sheets).alias("sheet_id"), F.floor(F.col("id") / sheets).cast("int").alias("row_pos"), cells.alias("cells"))
    manifest = spark.range(sheets).select(F.concat(F.lit("s/"), "id").alias("sheet_id"), F.col("id").cast("int").alias("position"))
    root = str(tmp_path / "book")
    workbook.write_workbook(table, manifest, root)
    assert len(list((tmp_path / "book" / "sheets").glob("*/*.json"))) <= workbook.LEAST_FOLDERS
    back = workbook.read_workbook(spark, root).select("sheet_id", "row_pos", F.col("cells")[0]["number"])
    assert rows(back, "sheet_id", "row_pos") == sorted((f"s/{i}", k, float(i + k * sheets)) for i in range(sheets) for k in range(2))
    one = workbook.read_workbook(spark, root, ("s/7",))
    assert len({f.split("/")[-2] for f in one.inputFiles()}) == 1
    assert rows(one.select("sheet_id", "row_pos"), "row_pos") == [("s/7", 0), ("s/7", 1)]
    assert [workbook.folders_for(n) for n in (0, 1, 64, 65, 16_384, 16_385, 360_000)] == [1, 1, 64, 64, 64, 65, 1_407]


# ---- header rules --------------------------------------------------------------------------------


def test_the_rules_survive_a_table(spark):
    assert statistics.rules_from_table(statistics.rules_table(spark)) == statistics.HEADER_RULES
    assert statistics.measures_of(statistics.HEADER_RULES) == statistics.MEASURES
    assert statistics.rules_from_table(statistics.rules_table(spark).limit(0)) == ()


def test_another_set_of_rules_needs_no_code(spark, tmp_path):
    table = spark.createDataFrame(
        [(2, "people", ["people"], False), (0, "state", ["region", "province"], True), (1, "peopleRural", ["people", "rural"], False)],
        "rule_order INT, key STRING, needles ARRAY<STRING>, exact BOOLEAN",
    )
    rules = statistics.rules_from_table(table)
    root = write(tmp_path, {"s": [["Province", "People, rural", "People", "Remarks", "Region name"], ["x", "1,5", 7, "?", "y"]]})
    found = keyed(spark, root, rules)
    assert found.columns == ["sheet_id", "row_pos", "state", "slNo", "peopleRural", "people"]
    assert rows(found.select("state", "slNo", "peopleRural", "people")) == [("x", None, 15.0, 7.0)]
    assert statistics.fill_totals(found).columns == found.columns
    assert rows(keyed(spark, root, ()).select("state", "slNo")) == [("", None)]


def test_too_many_rules_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(statistics, "MOST_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        statistics.rules_from_table(statistics.rules_table(spark))
