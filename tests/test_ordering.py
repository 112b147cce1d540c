from conftest import rows
from pyspark.sql import functions as F

from landroll.operators import ordering


def test_positions_equal_a_plain_sort(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 3).alias("hot"), F.when(F.col("id") % 3 == 0, 1).alias("gap"))
    order = [F.desc("hot"), F.asc_nulls_last("gap"), F.asc("id")]
    placed = ordering.with_positions(df.repartition(6), order)
    expected = [r["id"] for r in df.orderBy(*order).collect()]
    found = rows(placed.select("position", "id"), "position")
    assert [p for p, _ in found] == list(range(1, 5001))
    assert [i for _, i in found] == expected


def test_seeking_equals_paging(spark):
    df = spark.range(300).select("id", (F.col("id") % 10).alias("k"))
    order = [F.desc("k"), F.asc("id")]
    for page in (1, 5, 42, 43):
        last = rows(ordering.page_of(df, order, page, 7))[-1]
        seen = ordering.rows_after(df, [("k", "desc"), ("id", "asc")], (last[1], last[0]), 7)
        assert rows(seen) == rows(ordering.page_of(df, order, page + 1, 7))


def test_positions_within_groups_with_a_hot_and_a_null_group(spark):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 != 0, (F.col("id") % 40).cast("string"))
    df = spark.range(6000).select("id", group.alias("g"), (F.col("id") * 7919 % 11).alias("k"))
    placed = ordering.with_positions(df.repartition(5), [F.desc("k"), F.asc("id")], within=("g",))
    assert placed.columns == ["id", "g", "k", "position"]
    members = {}
    for row in df.collect():
        members.setdefault(row["g"], []).append((-row["k"], row["id"]))
    expected = {i: place for group in members.values() for place, (_, i) in enumerate(sorted(group), 1)}
    assert {r["id"]: r["position"] for r in placed.collect()} == expected
