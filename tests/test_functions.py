import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from landroll.functions import numbers, text, times


def applied(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[1] for r in rows(frame.select("i", expression(F.col("v"))), "i")]


def test_parse_number(spark):
    cases = {
        "-117*": -117.0, "1,234": 1234.0, "45%": 45.0, "1e5": 15.0, "(1.5)": 1.5, "12-3": None, "1.2.3": None,
        "NA/NR": None, "na": None, " NR ": None, "N/A": None, "-": None, "": None, "  ": None, ".": None, "-.": None,
        "5.": 5.0, ".5": 0.5, "--5": None, " 67,56,280 ": 6756280.0, None: None,
    }
    assert applied(spark, numbers.parse_number, list(cases)) == list(cases.values())


def test_parse_plain_number(spark):
    cases = {"": None, "0": 0.0, "abc": None, "5d": None, "5f": None, " 20.5 ": 20.5, "-1e2": -100.0, "NaN": None, None: None}
    assert applied(spark, numbers.parse_plain_number, list(cases)) == list(cases.values())


def by_hand(n):
    head, tail = str(n)[:-3], str(n)[-3:]
    pairs = [head[max(0, i - 2) : i] for i in range(len(head), 0, -2)][::-1]
    return ",".join([*pairs, tail])


def test_indian_number(spark):
    cases = {
        6756280.0: "67,56,280", 1234.0: "1,234", 123.0: "123", 0.0: "0", -1234567.0: "-12,34,567", 100000.0: "1,00,000",
        1234.5: "1,234.5", 0.12345: "0.123", 12345678901.25: "12,34,56,78,901.25", None: "—", float("nan"): "—",
        float("inf"): "∞", 2.0**120: by_hand(13292279957849159 * 10**20), -1e36: "-" + by_hand(10**36),
    }
    assert applied(spark, numbers.indian_number, list(cases), "double") == list(cases.values())


def test_number_text(spark):
    cases = {8.5: "8.5", 8.0: "8", 100.0: "100", -0.25: "-0.25", 0.0001: "0.0001", None: None}
    assert applied(spark, numbers.number_text, list(cases), "double") == list(cases.values())


def test_percent_text(spark):
    assert applied(spark, numbers.percent_text, [6.25, 100.0, None], "double") == ["6.3%", "100.0%", "—"]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        (lambda c: text.or_default(c, "d"), ["d", "d", " ", "x"]),
        (text.has_text, [False, False, True, True]),
        (text.empty_to_null, [None, None, " ", "x"]),
    ],
)
def test_defaults(spark, expression, expected):
    assert applied(spark, expression, [None, "", " ", "x"]) == expected


def test_whitespace(spark):
    every_blank = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert applied(spark, text.trim_ws, [f"{every_blank}a b{every_blank}", every_blank, None]) == ["a b", "", None]
    assert applied(spark, text.squeeze_ws, [f"a{every_blank}b\n c"]) == ["a b c"]


def test_join_nonempty(spark):
    frame = spark.createDataFrame([("a", "b"), ("", "b"), (None, ""), ("a", None)], "x STRING, y STRING")
    joined = frame.select(text.join_nonempty(["x", "y"], " · ", "none"))
    assert [r[0] for r in joined.collect()] == ["a · b", "b", "none", "a"]


def test_contains_is_literal(spark):
    found = applied(spark, lambda c: text.contains_ignoring_case(c, "A%_"), ["xa%_y", "abc", None])
    assert found == [True, False, False]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        frame = spark.sql(
            "SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.5' AS wall, TIMESTAMP '2024-03-10T23:30:00Z' AS instant"
        )
        found = frame.select(
            times.utc_iso_text(frame, "wall"), times.utc_iso_text(frame, "instant"),
            times.utc_day(frame, "wall"), times.utc_day(frame, "instant"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = dt.date(2024, 3, 10)
    assert tuple(found) == ("2024-03-10T02:30:00.500000+00:00", "2024-03-10T23:30:00.000000+00:00", day, day)
