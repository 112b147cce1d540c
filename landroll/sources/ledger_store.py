"""A ledger that is changed by commits: new claims, status changes and compaction, safe with several writers.

    root/claims/<attempt>/part-*.parquet            claims
    root/keys/attempt=<attempt>/part-*.parquet      text keys of those claims, bucketed and sorted by key
    root/commits/00000007.json                      what version 7 consists of

A change writes files under an attempt name of its own and then puts the commit file of the next version in its place, which
fails when there already is one. So a version is seen whole or not at all, an attempt that dies leaves files that nobody reads,
and of two writers of one version the first wins; the other starts again from what the winner left. Files are never changed:
a status change rewrites those files that hold a changed claim and keeps the others.

A commit file names the claim files with their rows and their range of `created_at`, so a page of the listing is read from the few
files that can hold it. It grows with the number of files, as Spark's own file listing does; compaction keeps that number down.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landroll.functions.text import has_text
from landroll.functions.times import utc_wall_clock
from landroll.operators.ingest import STORED_FIELDS, accepted, apply_status, latest_status, screen_claims, stored_rows, text_key
from landroll.operators.ledger import ROWS_PER_PAGE, ledger_after, newest_first
from landroll.operators.sizes import is_small, text_bytes

KEY_BUCKETS = 64
ROWS_PER_FILE = 2_000_000
TRIES = 20
STORED_TYPE = "id STRING, " + ", ".join(f"{c} {kind}" for c, kind in STORED_FIELDS.items()) + ", created_at TIMESTAMP_NTZ, text_key BINARY"


@dataclass(frozen=True)
class Version:
    """One version of a ledger: claim files [{path, rows, first, last}], attempts with text keys, and the buckets of these."""

    number: int = 0
    files: tuple[dict, ...] = ()
    attempts: tuple[str, ...] = ()
    buckets: int = KEY_BUCKETS

    def paths(self, root: str) -> list[str]:
        return [f"{root}/claims/{f['path']}" for f in self.files]


class Conflict(Exception):
    """Another writer committed every version that was tried."""


def _files(spark: SparkSession, root: str):
    """The file system that holds the ledger, and its path type."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _commit_names(spark: SparkSession, root: str) -> list[str]:
    files, path = _files(spark, root)
    found = files.globStatus(path(f"{root}/commits/[0-9]*.json")) or []
    return sorted(status.getPath().getName() for status in found)


def current_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The latest version, or the one asked for; version 0 is the empty ledger."""
    names = _commit_names(spark, root)
    if number == 0 or not names and number is None:
        return Version()
    name = names[-1] if number is None else f"{number:08d}.json"
    if name not in names:
        raise ValueError(f"no version {number} of {root}")
    text = spark.read.text(f"{root}/commits/{name}", wholetext=True).first()[0]
    said = json.loads(text)
    return Version(said["number"], tuple(said["files"]), tuple(said["attempts"]), said["buckets"])


def _commit(spark: SparkSession, root: str, version: Version) -> bool:
    """Put the version's commit file in its place; False when another writer was first."""
    files, path = _files(spark, root)
    hadoop = spark._jvm.org.apache.hadoop.fs
    text = json.dumps({"number": version.number, "files": version.files, "attempts": version.attempts, "buckets": version.buckets})
    draft, place = path(f"{root}/commits/_draft-{uuid.uuid4().hex}"), path(f"{root}/commits/{version.number:08d}.json")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(draft, place, spark._sc._gateway.new_array(hadoop.Options.Rename, 0))  # without the option to overwrite
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def read_claims(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The claims of a version (the latest by default)."""
    version = version or current_version(spark, root)
    if not version.files:
        return spark.createDataFrame([], STORED_TYPE)
    return spark.read.schema(STORED_TYPE).parquet(*version.paths(root))


# ---- text keys -----------------------------------------------------------------------------------


def _key_table(spark: SparkSession, root: str, buckets: int) -> str:
    """Name of the session's table over the key files; it is defined once per session and knows all attempts on file."""
    name = "landroll_keys_" + hashlib.sha256(root.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (text_key BINARY, attempt STRING) USING parquet PARTITIONED BY (attempt) "
            f"CLUSTERED BY (text_key) SORTED BY (text_key) INTO {buckets} BUCKETS LOCATION '{root}/keys'"
        )
    return name


def known_keys(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """(text_key) of all texts of a version, bucketed by key: joined or grouped by key without moving them."""
    version = version or current_version(spark, root)
    if not version.attempts:
        return spark.createDataFrame([], "text_key BINARY")
    name = _key_table(spark, root, version.buckets)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).where(F.col("attempt").isin(*version.attempts)).select("text_key")


def _write_keys(spark: SparkSession, root: str, attempt: str, keys: DataFrame, buckets: int) -> None:
    """The attempt's distinct keys, one file per bucket."""
    rows = keys.where("text_key IS NOT NULL").distinct().repartition(buckets, "text_key").withColumn("attempt", F.lit(attempt))
    writer = rows.write.mode("append").format("parquet").partitionBy("attempt").bucketBy(buckets, "text_key").sortBy("text_key")
    writer.option("path", f"{root}/keys").saveAsTable(_key_table(spark, root, buckets))


# ---- changes -------------------------------------------------------------------------------------


def _write_claims(spark: SparkSession, root: str, attempt: str, claims: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> list[dict]:
    """Write claims newest first, each file one run of the listing, and describe the files.

    Bloom filters on `id` let a lookup of one claim skip the row groups that do not hold it.
    """
    folder = f"{root}/claims/{attempt}"
    ordered = claims.select(*[c.split()[0] for c in STORED_TYPE.split(", ")]).orderBy(*newest_first())
    ordered.write.option("parquet.bloom.filter.enabled#id", "true").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    facts = spark.read.schema(STORED_TYPE).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name"))
    facts = facts.agg(F.count("created_at").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).collect()  # one row per file
    return [{"path": f"{attempt}/{r['name']}", "rows": r["rows"], "first": r["first"], "last": r["last"]} for r in sorted(facts, key=lambda r: r["name"])]


def _changed(spark: SparkSession, root: str, change: Callable[[Version, str], Version | None], tries: int) -> Version:
    """Prepare a change against the latest version and commit it, again if another writer was first."""
    for _ in range(tries):
        now = current_version(spark, root)
        wanted = change(now, uuid.uuid4().hex)
        if wanted is None:
            return now
        if _commit(spark, root, wanted):
            return wanted
    raise Conflict(f"{tries} versions of {root} were committed by others")


def import_claims(spark: SparkSession, root: str, claims: DataFrame, *, buckets: int = KEY_BUCKETS, tries: int = TRIES) -> Version:
    """Add claims that have their id and `created_at` already, without screening: an existing ledger moves in."""
    stamp = utc_wall_clock(claims, "created_at")
    key = F.when(has_text("raw_text"), text_key("raw_text")).alias("text_key")
    rows = stored_rows(claims.withColumn("id", F.col("id").cast("string")), stamp, keep=("id",)).select("*", key)

    def change(now: Version, attempt: str) -> Version:
        own = now.buckets if now.number else buckets
        files = _write_claims(spark, root, attempt, rows)
        _write_keys(spark, root, attempt, spark.read.schema(STORED_TYPE).parquet(f"{root}/claims/{attempt}").select("text_key"), own)
        return Version(now.number + 1, (*now.files, *files), (*now.attempts, attempt), own)

    return _changed(spark, root, change, tries)


def add_batch(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    *,
    created_at: Column | None = None,
    new_id: Column | None = None,
    arrival: str = "arrival",
    tries: int = TRIES,
) -> Version:
    """Screen a batch of new claims against the ledger and add those that are accepted.

    A batch that meets another commit is screened again, so a text is stored once however many batches bring it at a
    time; the first committed keeps it. `screen_batch` gives the rejected rows.
    """

    def change(now: Version, attempt: str) -> Version | None:
        taken = accepted(screen_batch(spark, root, batch, now, arrival=arrival))
        rows = taken.withColumn("id", F.expr("uuid()") if new_id is None else new_id)
        rows = stored_rows(rows, created_at, keep=("id",))
        rows = rows.withColumn("created_at", utc_wall_clock(rows, "created_at"))
        files = _write_claims(spark, root, attempt, rows.withColumn("text_key", F.when(has_text("raw_text"), text_key("raw_text"))))
        if not files:
            return None
        _write_keys(spark, root, attempt, spark.read.schema(STORED_TYPE).parquet(f"{root}/claims/{attempt}").select("text_key"), now.buckets)
        return Version(now.number + 1, (*now.files, *files), (*now.attempts, attempt), now.buckets)

    return _changed(spark, root, change, tries)


def screen_batch(spark: SparkSession, root: str, batch: DataFrame, version: Version | None = None, *, arrival: str = "arrival") -> DataFrame:
    """The batch with `reject_reason`, screened by the key table: no text and no row of the ledger is read or moved."""
    version = version or current_version(spark, root)
    buckets = version.buckets if version.attempts else None
    return screen_claims(batch, known_keys(spark, root, version), arrival=arrival, ledger_key="text_key", ledger_buckets=buckets)


def change_statuses(
    spark: SparkSession,
    root: str,
    updates: DataFrame,
    *,
    claim_id: str = "claim_id",
    status: str = "status",
    order: tuple[str, ...] = ("ts", "event_id"),
    tries: int = TRIES,
) -> Version:
    """Store the last non-empty status of each claim. Files without a changed claim stay as they are.

    Changes of unknown claims change nothing; `ingest.status_rejects` lists them.
    """
    few = is_small(text_bytes(updates, [claim_id, status]))

    def change(now: Version, attempt: str) -> Version | None:
        if not now.files:
            return None
        ids = latest_status(updates, claim_id=claim_id, status=status, order=order).select(F.col(claim_id).alias("id"))
        held = read_claims(spark, root, now).select("id", F.col("_metadata.file_path").alias("file"))
        touched = held.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("file").distinct().collect()  # one row per file
        names = {"/".join(r["file"].split("/")[-2:]) for r in touched}
        old = [f for f in now.files if f["path"] in names]
        if not old:
            return None
        rows = spark.read.schema(STORED_TYPE).parquet(*[f"{root}/claims/{f['path']}" for f in old])
        files = _write_claims(spark, root, attempt, apply_status(rows, updates, claim_id=claim_id, status=status, order=order))
        stay = [f for f in now.files if f["path"] not in names]
        return Version(now.number + 1, (*stay, *files), now.attempts, now.buckets)

    return _changed(spark, root, change, tries)


def compact(spark: SparkSession, root: str, *, rows_per_file: int = ROWS_PER_FILE, tries: int = TRIES) -> Version:
    """Rewrite all claims as runs of the listing, and all keys as one attempt: few files, whose ranges do not overlap."""

    def change(now: Version, attempt: str) -> Version | None:
        if not now.files:
            return None
        files = _write_claims(spark, root, attempt, read_claims(spark, root, now), rows_per_file)
        _write_keys(spark, root, attempt, known_keys(spark, root, now), now.buckets)
        return Version(now.number + 1, tuple(files), (attempt,), now.buckets)

    return _changed(spark, root, change, tries)


# ---- pages ---------------------------------------------------------------------------------------


def files_of_page(version: Version, after: str | None, rows_per_page: int = ROWS_PER_PAGE) -> list[dict]:
    """The files that can hold the page behind a moment (`yyyy-MM-dd HH:mm:ss.SSSSSS`); None: the first page.

    Files that lie wholly behind the moment are counted from the newest start until they fill the page; whatever ends before the
    start of the last one counted cannot be on it.
    """
    dated = [f for f in version.files if f["last"] is not None]
    open_files = [f for f in dated if after is None or f["first"] <= after]
    behind = sorted((f for f in open_files if after is None or f["last"] < after), key=lambda f: f["first"], reverse=True)
    rows = 0
    for f in behind:
        rows += f["rows"]
        if rows >= rows_per_page:
            return [g for g in open_files if g["last"] >= f["first"]]
    return open_files


def page_after(spark: SparkSession, root: str, after: tuple | None = None, *, rows_per_page: int = ROWS_PER_PAGE, version: Version | None = None) -> DataFrame:
    """The page of the listing behind a row given by its (created_at as ISO text in UTC, id); it opens only files that can hold it."""
    version = version or current_version(spark, root)
    moment = datetime.fromisoformat(after[0]).isoformat(" ", "microseconds") if after else None
    files = files_of_page(version, moment, rows_per_page)
    if not files:
        return spark.createDataFrame([], STORED_TYPE)
    claims = spark.read.schema(STORED_TYPE).parquet(*[f"{root}/claims/{f['path']}" for f in files])
    if after is None:
        return claims.where("created_at IS NOT NULL").orderBy(*newest_first()).limit(rows_per_page)
    return ledger_after(claims, (datetime.fromisoformat(after[0]), after[1]), rows_per_page=rows_per_page)
