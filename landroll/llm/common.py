"""Shared folder, written intermediate tables and the hold-out rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows (a few numbers each) that may be sent to every executor: some 30 MB.
SMALL_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or on a local master a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="landroll-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_or_not(table: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of narrow rows, to be sent to the other side of a join where it is counted and small."""
    return F.broadcast(table) if table.count() <= most_rows else table


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most so many bytes in all, a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > most_bytes:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    yield batch.slice(first)
