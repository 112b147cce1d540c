"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; what it returns is written as
Parquet and read again as the next stage's documents. All stages but the last keep the columns of documents.

Defined results: the operators' own (see their modules); rows that repeat an id count as one document, of
which the near-duplicate stage keeps the smallest row; rows with a null id pass every filter that they deserve;
an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landroll.llm import decontaminate, minhash_dups, packing, quality, secret_scan
from landroll.llm.common import new_folder, saved
from landroll.llm.queries import WORD_TOKENIZER, ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), meta_cols=("n_chars",))
    return quality.keep_quality(docs, model, meta_cols=("n_chars",))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    ship_package(spark)
    gone = saved(minhash_dups.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    stays = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return stays
    row = F.struct(*(F.col(c) for c in docs.columns))
    first = stays.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return stays.join(again, "doc_id", "left_anti").select(*docs.columns).union(first.select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced."""
    ship_package(spark)
    return secret_scan.redact_secrets(docs, repository=F.concat_ws("/", "source", "lang"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("secrets", redact),
    ("packing", pack),
]

#: The quality model and the tokenizer have no SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
