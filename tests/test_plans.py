"""Plans keep the shape they are meant to have, also without broadcasts."""

import re

import pytest

from landroll.operators import ingest, sizes
from landroll.plans.queries import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_plan_is_spread_out(spark, folder, name, no_broadcast):
    """No Python, no cross join; a single-partition exchange only carries aggregates."""
    plan = physical(QUERIES[name](spark, folder))
    for bad in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1]


@pytest.mark.parametrize("name", ["ledger_page", "stats_top10"])
def test_top_k_is_bounded(spark, folder, name):
    assert "TakeOrderedAndProject" in physical(QUERIES[name](spark, folder))


def test_daily_total_aggregates_before_its_window(spark, folder):
    plan = physical(QUERIES["claims_cumulative"](spark, folder))
    assert plan.index("Window") < plan.index("HashAggregate")


def test_texts_are_shuffled_as_keys(spark, folder, no_broadcast, monkeypatch):
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", -1)
    new, held = "arrival BIGINT, name STRING, raw_text STRING", "raw_text STRING"
    plan = physical(ingest.screen_claims(spark.createDataFrame([], new), spark.createDataFrame([], held)))
    assert len(re.findall(r"hashpartitioning\(text_key", plan)) == 2
    assert len(re.findall(r"hashpartitioning\(arrival|hashpartitioning\(_fresh", plan)) == 2
    assert "partial_min(arrival" in plan


def test_a_small_batch_filters_the_ledger_where_it_is_read(spark, folder):
    plan = physical(QUERIES["ingest_dedup"](spark, folder))
    assert re.search(r"BroadcastHashJoin \[text_key#\d+\], \[text_key#\d+\], LeftSemi", plan)


def test_first_two_places_are_cut_before_the_shuffle(spark, folder):
    plan = physical(QUERIES["entity_places"](spark, folder))
    partial = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    shuffle = [i for i, line in enumerate(plan.splitlines()) if "hashpartitioning(doc_id" in line and "kind" in line]
    assert len(partial) == 2 and partial[0] < shuffle[0] < partial[1]


def test_counts_read_only_their_columns(spark, folder):
    plan = physical(QUERIES["claims_by_status"](spark, folder))
    orders = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderkey" in line)
    assert "o_totalprice" not in orders and "o_orderpriority" not in orders


def test_facet_and_id_filters_reach_the_files(spark, tmp_path):
    from landroll.operators import ledger

    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "S", "Approved")], "id STRING, state STRING, status STRING").write.parquet(path)
    table = spark.read.parquet(path)
    assert "EqualTo(state,S)" in physical(ledger.facet_filter(table, state="S"))
    assert "EqualTo(id,1)" in physical(ledger.claim_by_id(table, "1"))
    pending = physical(ledger.default_status(ledger.facet_filter(table, status="Pending")))
    assert re.search(r"PushedFilters: \[Or\(IsNull\(status\),\s*In\(status", pending)
