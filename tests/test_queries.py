"""Every registered query against its SQL, rows, names and types."""

import pytest
from compare import connect, differences, rows_of

from __spark_entry__ import entry, oracle_sql, queries
from landroll.plans.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, folder, name):
    assert differences(spark, con, folder, name, queries()[name], oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(oracle_sql()) & set(QUERIES) == set(QUERIES) <= set(queries())


def test_comparison_sees_a_difference(spark, con, folder):
    wrong = oracle_sql()["claims_by_status"].replace("'Pending'", "'Waiting'")
    assert differences(spark, con, folder, "claims_by_status", queries()["claims_by_status"], wrong)
    assert rows_of(["a", "b"], [(1, 2)]) == rows_of(["b", "a"], [(2, 1)]) != rows_of(["a", "b"], [(2, 1)])


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["day", "n", "running_total"]
    days = df.collect()
    assert days and days[-1]["running_total"] == sum(d["n"] for d in days)
