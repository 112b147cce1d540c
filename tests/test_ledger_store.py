"""Commits of the ledger store: status changes, batches, conflicts, key table, pages."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from landroll.operators import ingest, sizes
from landroll.sources import ledger_store as store

CLAIM = "id STRING, name STRING, status STRING, raw_text STRING, created_at TIMESTAMP_NTZ"
BATCH = "arrival BIGINT, name STRING, raw_text STRING"
UPDATE = "claim_id STRING, status STRING, ts INT, event_id INT"
STAMP = dt.datetime(2024, 1, 1)


def claims(spark, ids, day=lambda i: STAMP + dt.timedelta(days=i)):
    return spark.createDataFrame([(str(i), f"n{i}", None, f"text {i}", day(i)) for i in ids], CLAIM)


def batch(spark, rows):
    return spark.createDataFrame(rows, BATCH)


def moved_in(spark, root, rows):
    return store.import_claims(spark, root, rows, buckets=4)


def add(spark, root, rows, **more):
    return store.add_batch(spark, root, batch(spark, rows), created_at=F.lit(STAMP), new_id=F.concat(F.lit("b"), "arrival"), **more)


def files_on_disk(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("claims/*/part-*.parquet")}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "ledger")


def held(spark, root, *columns):
    return sorted(tuple(r) for r in store.read_claims(spark, root).select(*columns).collect())


def test_a_status_change_is_stored_and_leaves_other_files_alone(spark, root):
    for start in (0, 100, 200):
        moved_in(spark, root, claims(spark, range(start, start + 20)))
    before, was = files_on_disk(root), store.current_version(spark, root)
    updates = spark.createDataFrame([("105", "Approved", 1, 1), ("105", "Rejected", 2, 2), ("105", "", 3, 3), ("gone", "Approved", 1, 4)], UPDATE)
    now = store.change_statuses(spark, root, updates)
    after = files_on_disk(root)
    assert {name: after[name] for name in before} == before and len(after) > len(before)
    gone = {f["path"] for f in was.files} - {f["path"] for f in now.files}
    assert 0 < len(gone) < len(was.files) and all(f["first"] <= "2024-04-15" <= f["last"] for f in was.files if f["path"] in gone)
    rows = held(spark, root, "id", "name", "status", "raw_text")
    assert len(rows) == 60 and [r for r in rows if r[2]] == [("105", "n105", "Rejected", "text 105")]
    assert store.read_claims(spark, root, was).where("status IS NOT NULL").count() == 0
    assert store.current_version(spark, root, 0).files == ()


def test_changes_that_change_nothing_make_no_version(spark, root):
    updates = spark.createDataFrame([("gone", "Approved", 1, 1), ("1", "", 1, 2)], UPDATE)
    assert store.change_statuses(spark, root, updates).number == 0
    moved_in(spark, root, claims(spark, range(3)))
    assert store.change_statuses(spark, root, updates).number == 1
    assert store.change_statuses(spark, root, updates.limit(0)).number == 1
    assert add(spark, root, []).number == 1
    assert add(spark, root, [(1, None, "new"), (2, "n", "text 1")]).number == 1


def test_a_write_that_dies_leaves_the_old_state(spark, root, monkeypatch):
    moved_in(spark, root, claims(spark, range(10)))
    before = held(spark, root, "id", "status")

    def dies(*_):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(store, "_commit", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.change_statuses(spark, root, spark.createDataFrame([("1", "Approved", 1, 1)], UPDATE))
    with pytest.raises(RuntimeError, match="lost"):
        add(spark, root, [(1, "n", "fresh")])
    monkeypatch.undo()
    assert held(spark, root, "id", "status") == before and store.current_version(spark, root).number == 1
    add(spark, root, [(1, "n", "fresh")])  # keys of the dead attempt do not count
    assert ("b1", None) in held(spark, root, "id", "status")


@pytest.mark.parametrize("first", ["a", "b"])
def test_overlapping_batches_store_every_text_once(spark, root, monkeypatch, first):
    """While one batch is being written another is committed: the first committed keeps the common text."""
    moved_in(spark, root, claims(spark, range(3)))
    rows = {"a": [(1, "a", "common"), (2, "a", "only a"), (3, "a", "text 1")], "b": [(11, "b", "only b"), (12, "b", "common"), (13, None, "no name")]}
    second = "b" if first == "a" else "a"
    commit, waiting = store._commit, [first]

    def meets_another(spark_, root_, version):
        if waiting:
            add(spark, root, rows[waiting.pop()])
        return commit(spark_, root_, version)

    monkeypatch.setattr(store, "_commit", meets_another)
    now = add(spark, root, rows[second])
    texts = [t for (t,) in held(spark, root, "raw_text")]
    assert now.number == 3 and sorted(texts) == sorted(["text 0", "text 1", "text 2", "common", "only a", "only b"])
    assert [n for n, t in held(spark, root, "name", "raw_text") if t == "common"] == [first]


def test_a_status_change_meets_a_batch(spark, root, monkeypatch):
    moved_in(spark, root, claims(spark, range(5)))
    commit, waiting = store._commit, [1]

    def meets_another(spark_, root_, version):
        if waiting:
            waiting.pop()
            add(spark, root, [(7, "late", "late text")])
        return commit(spark_, root_, version)

    monkeypatch.setattr(store, "_commit", meets_another)
    store.change_statuses(spark, root, spark.createDataFrame([("b7", "Approved", 1, 1), ("2", "Rejected", 1, 2)], UPDATE))
    assert [r for r in held(spark, root, "id", "status") if r[1]] == [("2", "Rejected"), ("b7", "Approved")]


def test_a_writer_gives_up_after_its_tries(spark, root, monkeypatch):
    moved_in(spark, root, claims(spark, range(2)))
    monkeypatch.setattr(store, "_commit", lambda *_: False)
    with pytest.raises(store.Conflict):
        add(spark, root, [(1, "n", "fresh")], tries=2)


def test_a_version_is_committed_once(spark, root):
    assert store._commit(spark, root, store.Version(1, ({"path": "x"},)))
    assert not store._commit(spark, root, store.Version(1, ({"path": "y"},)))
    assert store.current_version(spark, root).files[0]["path"] == "x"
    assert not [p for p in Path(root, "commits").iterdir() if p.name.startswith("_draft")]


@pytest.mark.parametrize("broadcast_bytes", [sizes.BROADCAST_BYTES, -1])
def test_a_batch_meets_the_key_table_without_moving_it(spark, root, monkeypatch, broadcast_bytes):
    moved_in(spark, root, claims(spark, range(40)))
    add(spark, root, [(i, "n", f"more {i}") for i in range(40)])
    add(spark, root, [(i, "n", f"still more {i}") for i in range(100, 140)])
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", broadcast_bytes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        screened = store.screen_batch(spark, root, batch(spark, [(1, "n", "more 3"), (2, "n", "new"), (3, "n", "new"), (4, "n", "still more 101"), (5, "n", "text 7"), (6, "", "x"), (7, "n", "")]))
        plan = screened._jdf.queryExecution().executedPlan().toString()
        found = {r["arrival"]: r["reject_reason"] for r in screened.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    saved = ingest.ALREADY_SAVED
    assert found == {1: saved, 2: None, 3: saved, 4: saved, 5: saved, 6: ingest.NAME_REQUIRED, 7: None}
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    depth = len(re.match(r"[\s:|+-]*", lines[scan]).group())
    above, limit = [], depth
    for line in reversed(lines[:scan]):  # the nodes on the way from the scan of the keys up to the join
        own = len(re.match(r"[\s:|+-]*", line).group())
        if own < limit:
            limit = own
            above.append(line)
            if "Join" in line and "LeftAnti" in line:
                break
    assert above and "LeftAnti" in above[-1] and not any("Exchange" in line for line in above), plan
    assert "raw_text" not in lines[scan]


def test_keys_are_found_by_another_session(spark, root):
    moved_in(spark, root, claims(spark, range(5)))
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    other.sql(f"DROP TABLE {store._key_table(spark, root, 4)}")  # what another session has never heard of
    add(spark, root, [(1, "n", "text 3"), (2, "n", "fresh")])
    assert {t for (t,) in held(spark, root, "raw_text")} == {f"text {i}" for i in range(5)} | {"fresh"}


def test_pages_open_the_files_that_can_hold_them(spark, root):
    for start in (200, 0, 100):
        moved_in(spark, root, claims(spark, range(start, start + 50)))
    moved_in(spark, root, claims(spark, [300, 301], day=lambda i: None))
    version = store.compact(spark, root, rows_per_file=20)
    assert len(version.attempts) == 1 and store.known_keys(spark, root).count() == 152
    listing = [r["id"] for r in store.read_claims(spark, root).where("created_at IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).collect()]
    seen, after, opened = [], None, []
    while True:
        page = store.page_after(spark, root, after, rows_per_page=7)
        opened.append(len(page.inputFiles()))
        rows = page.collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        after = (rows[-1]["created_at"].isoformat(), rows[-1]["id"])
    assert seen == listing and len(version.files) > 4 and max(opened) <= 2


def test_files_of_a_page():
    files = [{"path": f"{a}-{b}", "rows": 10, "first": f"{a:02d}", "last": f"{b:02d}"} for a, b in ((0, 9), (10, 19), (20, 29), (5, 25))] + [{"path": "none", "rows": 0, "first": None, "last": None}]
    version = store.Version(1, tuple(files))
    names = lambda after, n: [f["path"] for f in store.files_of_page(version, after, n)]
    assert names(None, 5) == ["20-29", "5-25"]
    assert names("20", 5) == ["10-19", "20-29", "5-25"]
    assert names("04", 5) == ["0-9"] and names("99", 100) == ["0-9", "10-19", "20-29", "5-25"]
