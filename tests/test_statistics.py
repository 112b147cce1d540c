import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import panel, statistics
from landroll.sources import statistics_json, workbook

SHEET = "sheet_id STRING, row_pos INT, cells ARRAY<STRING>"


def sheet(spark, *lines, sheet_id="June_2024"):
    frame = spark.createDataFrame([(sheet_id, i, list(cells)) for i, cells in enumerate(lines)], SHEET)
    return statistics.value_rows(frame), statistics.header_rows(frame)


def keys_of(spark, headers):
    values, head = sheet(spark, headers)
    return [r["key"] for r in statistics.header_map(head).orderBy("idx").collect()]


def test_header_keys(spark):
    cases = {
        "Sl. No.": "slNo", " S.No. ": "slNo", "STATES/UT": "state", "State": "state", "State name": None,
        "No. of  Claims\nReceived  (Individual)": "claimsReceivedIndividual",
        "Number of claims received - community": "claimsReceivedCommunity",
        "Total claims received": "claimsReceivedTotal", "No. of Titles Distributed Individual": "titlesDistributedIndividual",
        "Titles Distributed (Total)": "titlesDistributedTotal", "Pending claims, community": "pendingCommunity",
        "Pending claims total": None, "Claims Rejected Total": "rejectedTotal", "Forest land (Individual) acres": "forestLandIndividual",
        "Extent of forest land for which titles distributed (Individual)": "titlesDistributedIndividual",
        "Extent of Forest Land Community": "forestLandCommunity", "claims received individual total": "claimsReceivedIndividual",
        "Remarks": None, "": None, None: None,
    }
    assert keys_of(spark, list(cases)) == list(cases.values())


def test_the_last_column_of_a_key_wins_even_when_empty(spark):
    values, head = sheet(
        spark,
        ["State", "Titles distributed individual", "Forest land for titles distributed individual"],
        ["Odisha", "10", "99"],
        ["Assam", "11", None],
        ["Kerala", "12"],  # the short row has no third column
        [None, " ", None],
        ["TOTAL", "33", "99"],
        ["Grand Total", "34", "1"],
        [None, "35", "1"],
    )
    keyed = statistics.keyed_rows(values, head)
    assert rows(keyed.select("row_pos", "state", "titlesDistributedIndividual"), "row_pos") == [
        (1, "Odisha", 99.0), (2, "Assam", None), (3, "Kerala", 12.0), (5, "TOTAL", 99.0), (6, "Grand Total", 1.0), (7, "", 1.0),
    ]
    assert rows(statistics.state_rows(keyed).select("state"), "row_pos") == [
        ("Odisha",), ("Assam",), ("Kerala",), ("Grand Total",),
    ]


def test_cells_beyond_the_header_are_ignored(spark):
    values, head = sheet(spark, ["State", "Claims received total"], ["Odisha", "5", "77", "78"])
    assert rows(statistics.keyed_rows(values, head).select("claimsReceivedTotal")) == [(5.0,)]


def test_totals(spark):
    parts = ["State", "Claims received individual", "Claims received community", "Claims received total", "Claims rejected individual"]
    values, head = sheet(
        spark, parts,
        ["a", None, None, None, "1"], ["b", "5", None, "NA", "1"], ["c", None, "7", "12-3", "1"], ["d", "5", "7", "20", "1"],
        ["e", "5", "7", "0", "1"],
    )
    filled = statistics.fill_totals(statistics.keyed_rows(values, head))
    assert rows(filled.select("claimsReceivedTotal", "rejectedTotal"), "state") == [
        (None, None), (5.0, None), (7.0, None), (20.0, None), (0.0, None),
    ]


def test_periods(spark):
    frame = spark.createDataFrame([("OCT_2023", 5), ("other", 0), ("June_2024", 9)], "sheet_id STRING, place INT")
    found = statistics.with_period_order(statistics.with_period_meta(frame), "place")
    assert rows(found.select("sheet_id", "label", "as_of", "period_order"), "period_order") == [
        ("June_2024", "June 2024", dt.date(2024, 6, 30), 0),
        ("OCT_2023", "October 2023", dt.date(2023, 10, 31), 1),
        ("other", "other", None, 4),
    ]


def clean(spark):
    frames = [
        sheet(
            spark, ["Sl. No.", "States", "Claims received total", "Titles distributed total", "Pending claims community"],
            ["1", " Tripura ", "2,01,000", "1,28,000", "7"], ["2", "odisha", "6,76,000", "4,68,000", None], ["3", "Assam", "NR", None, None],
        ),
        sheet(spark, ["State", "Claims received total"], ["Kerala", "0"], sheet_id="misc"),
    ]
    values = statistics.union_sheets([v for v, _ in frames])
    heads = statistics.union_sheets([h for _, h in frames])
    return statistics.clean_statistics(values, heads, workbook_position=F.lit(0))


def test_json_round_trip(spark, tmp_path):
    table = clean(spark)
    path = str(tmp_path / "stats")
    statistics_json.write_statistics(table, path, "book")
    back = statistics_json.read_statistics(spark, path)
    columns = ["sheet_id", "label", "as_of", "period_order", "slNo", "state", *statistics.MEASURES]
    assert rows(back.select(columns), "sheet_id", "row_pos") == rows(table.select(columns), "sheet_id", "row_pos")
    text = "".join(r["value"] for r in spark.read.text(path).collect())
    assert "pendingIndividual" not in text and "firstRow" not in text


def test_the_size_of_parts_does_not_show(spark):
    wide = spark.range(1, 1001).select(
        F.lit("p").alias("sheet_id"), F.lit("p").alias("label"), F.lit(None).cast("date").alias("as_of"),
        F.lit(0).alias("period_order"), F.col("id").cast("int").alias("row_pos"), F.lit(None).cast("double").alias("slNo"),
        F.concat(F.lit("s"), "id").alias("state"),
        *[F.col("id").cast("double").alias(m) for m in statistics.MEASURES],
    )
    for size in (1, 64, 999, 1000, 5000):
        nested = statistics.nest_periods(wide, "book", rows_per_part=size)
        assert nested.count() == 1
        back = statistics.flatten_periods(nested)
        assert rows(back.select("row_pos", "state"), "row_pos") == [(i - 1, f"s{i}") for i in range(1, 1001)]


def test_periods_without_rows_stay(spark):
    table = clean(spark)
    listed = table.select("sheet_id", "label", "as_of", "period_order").distinct()
    listed = listed.union(spark.sql("SELECT 'gone', 'gone', CAST(NULL AS DATE), 9"))
    assert ("gone", 0.0) in rows(panel.sum_field(table, "pendingIndividual", listed))
    shown = {r["sheet_id"]: r for r in panel.period_kpis(table, listed).collect()}["gone"]
    assert (shown["claims"], shown["titles"], shown["states"], shown["rate_text"]) == (0.0, 0.0, 0, "—")
    flags = {r["sheet_id"]: tuple(r)[1:] for r in panel.available_measures(table, listed).collect()}
    assert flags["gone"] == (False, False, False)
    nested = statistics.nest_periods(table, "book", listed).select(F.inline("periods"))
    assert rows(nested.where("id = 'gone'").select(F.size("rows"))) == [(0,)]


def test_reading_one_document_with_all_periods(spark, tmp_path):
    (tmp_path / "stats.json").write_text(
        """{
          "source": "book",
          "periods": [
            {"id": "b", "label": "B", "asOf": "2024-06-30", "rows": [{"slNo": 1, "state": "X", "rejectedTotal": 2.5}, {"state": "Y"}]},
            {"id": "a", "label": "a", "asOf": null, "rows": [{"state": "Z", "claimsReceivedTotal": 3}]}
          ]
        }"""
    )
    back = statistics_json.read_statistics(spark, str(tmp_path / "stats.json"), single_document=True)
    found = back.select("period_order", "sheet_id", "as_of", "row_pos", "state", "rejectedTotal", "claimsReceivedTotal")
    assert rows(found, "period_order", "row_pos") == [
        (0, "b", dt.date(2024, 6, 30), 0, "X", 2.5, None), (0, "b", dt.date(2024, 6, 30), 1, "Y", None, None),
        (1, "a", None, 0, "Z", None, 3.0),
    ]


def test_workbook_files(spark, tmp_path):
    for name, lines in {
        "June_2024": '0,State,"Claims received\nTotal",\n1,"Odisha","1,234",\n2,,,\n',
        "misc": "0,State,Titles distributed total,Remarks\n1,Assam,7,none\n",
    }.items():
        (tmp_path / f"sheet_id={name}").mkdir()
        (tmp_path / f"sheet_id={name}" / "sheet.csv").write_text(lines)
    sheets = workbook.check_sheets(workbook.read_sheets(spark, str(tmp_path), columns=3))
    table = statistics.clean_statistics(statistics.value_rows(sheets), statistics.header_rows(sheets), workbook_position=F.lit(0))
    assert rows(table.select("sheet_id", "state", "claimsReceivedTotal", "titlesDistributedTotal"), "sheet_id") == [
        ("June_2024", "Odisha", 1234.0, None), ("misc", "Assam", None, 7.0),
    ]


def test_workbook_errors(spark, tmp_path):
    (tmp_path / "sheet_id=x").mkdir()
    (tmp_path / "sheet_id=x" / "sheet.csv").write_text("1,Odisha,5\n")
    sheets = workbook.read_sheets(spark, str(tmp_path), columns=2)
    try:
        workbook.check_sheets(sheets)
        raise AssertionError("a sheet without header must be an error")
    except ValueError as error:
        assert "sheet x is empty" in str(error)
    (tmp_path / "sheet_id=x" / "sheet.csv").write_text("0,State,Claims\n1,Odisha,5,6\n")
    try:
        workbook.read_sheets(spark, str(tmp_path), columns=2).collect()
        raise AssertionError("a cell beyond the declared width must be an error")
    except Exception as error:
        assert "MALFORMED" in str(error).upper()


STATS = "sheet_id STRING, row_pos INT, state STRING, claimsReceivedTotal DOUBLE, titlesDistributedTotal DOUBLE, period_order INT"


def test_sorting(spark):
    df = spark.createDataFrame(
        [("p", 1, "b", 5.0, 1.0, 0), ("p", 2, "A", None, 1.0, 0), ("p", 3, "a", -1.0, 1.0, 0), ("p", 4, "B", 5.0, 1.0, 0)], STATS
    )

    def order(*args):
        return [r["row_pos"] for r in panel.sort_rows(df, *args).collect()]

    assert order() == [1, 4, 3, 2]
    assert order("claimsReceivedTotal", "asc") == [2, 3, 1, 4]
    assert order("state") == [3, 2, 1, 4]
    assert order("state", "desc") == [4, 1, 2, 3]
    assert panel.default_direction("state") == "asc"
    assert panel.default_direction("slNo", current=("state", "asc")) == "desc"
    assert panel.default_direction("state", current=("state", "asc")) == "desc"


def test_top_states_counts_null_as_zero(spark):
    df = spark.createDataFrame(
        [("p", 1, "minus", -1.0, 1.0, 0), ("p", 2, "none", None, None, 0), ("p", 3, "five", 5.0, 2.0, 0), ("p", 4, "five too", 5.0, None, 0)],
        STATS,
    )
    assert rows(panel.top_states(df, 3).select("state", "claims", "titles")) == [
        ("five", 5.0, 2.0), ("five too", 5.0, 0.0), ("none", 0.0, 0.0),
    ]


def test_kpis(spark):
    df = spark.createDataFrame([("p", 1, "a", 16.0, 1.0, 0), ("q", 1, "a", None, None, 1), ("q", 2, "b", 0.0, 9.0, 1)], STATS)
    found = panel.period_kpis(df).orderBy("sheet_id").collect()
    assert [(r["claims"], r["titles"], r["states"], r["rate"], r["rate_text"]) for r in found] == [
        (16.0, 1.0, 2 - 1, 6.25, "6.3%"), (0.0, 9.0, 2, None, "—"),
    ]
    periods = spark.createDataFrame([("p", 0), ("q", 1), ("empty", 2)], "sheet_id STRING, period_order INT")
    assert rows(panel.load_summary(df, periods)) == [(3, 3)]
    picked = panel.pick_periods(df, periods, ("q", "zz"))
    assert rows(picked.select("wanted", "sheet_id", "row_pos"), "wanted", "row_pos") == [("q", "q", 1), ("q", "q", 2), ("zz", "p", 1)]


def test_panel_on_the_long_table(spark):
    table = clean(spark)
    shown = {r["state"]: r for r in panel.table_rows(table).collect()}
    assert shown["Tripura"]["claims_text"] == "2,01,000"
    assert shown["Tripura"]["claims_parts"] == "I — · C —"
    assert shown["Tripura"]["pending_text"] == "— / 7"
    assert shown["odisha"]["pending_text"] == "— / —"
    assert shown["Kerala"]["pending_text"] is None
    assert shown["Assam"]["rejected_text"] is None
    flags = panel.with_focus_flag(table).where("is_focus").select("state")
    assert rows(flags) == [("Tripura",)]  # exact match: "odisha" is none
    measures = {r["sheet_id"]: (r["has_pending"], r["has_rejected"], r["has_forest_land"]) for r in panel.available_measures(table).collect()}
    assert measures == {"June_2024": (True, False, False), "misc": (False, False, False)}
    assert rows(panel.sum_field(table, "pendingIndividual"), "sheet_id") == [("June_2024", 0.0), ("misc", 0.0)]
