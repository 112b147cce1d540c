"""Parquet tables: the ledger and the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landroll.functions.text import has_text
from landroll.operators.ingest import stored_rows, text_key


def read_table(spark: SparkSession, folder: str, name: str, *, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema given, no file is opened before the query runs."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def append_claims(
    accepted: DataFrame, path: str, *, created_at: Column | None = None, new_id: Column | None = None
) -> None:
    """Append accepted claims to a ledger: stored fields, id, timestamp, and the text key.

    The stored text key lets later batches look for duplicates without reading the ledger's texts.
    Bloom filters on `id` let a lookup of one claim skip the row groups that do not hold it.
    """
    identified = accepted.withColumn("id", F.expr("uuid()") if new_id is None else new_id)
    key = F.when(has_text("raw_text"), text_key("raw_text")).alias("text_key")
    rows = stored_rows(identified, created_at, keep=("id",))
    writer = rows.select("*", key).write.mode("append").option("parquet.bloom.filter.enabled#id", "true")
    writer.parquet(path)
