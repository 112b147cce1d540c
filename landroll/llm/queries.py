"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import landroll
from landroll.llm import (
    archives, centroids, decontaminate, embedding_dups, language, minhash_dups, packing, quality, quality_rules, secret_scan, spelling,
    token_counts, url_trust,
)
from landroll.llm.oracles import ORACLES

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, unless their Python finds it where this one did."""
    root = Path(landroll.__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("landroll.shipped", None):
        return
    folder = Path(tempfile.mkdtemp(prefix="landroll-package-"))
    with zipfile.ZipFile(folder / "landroll.zip", "w") as z:
        for path in sorted((root / "landroll").rglob("*.py")):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(folder / "landroll.zip"))
    spark.conf.set("landroll.shipped", "true")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def ready(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    return ready


def op1_embedding_dups(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dups.near_vectors(_table(spark, folder, "embeddings"))


def op2_minhash_dups(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dups.near_duplicates(_table(spark, folder, "documents"))


def op3_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.judge_urls(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), WORD_TOKENIZER)


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts before and after a paragraph break is put into the middle of each text and its secrets are replaced."""
    docs = _table(spark, folder, "documents")
    spans = F.transform(secret_scan.base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("[SECRET]").alias("replacement")))
    middle = F.floor(F.length("text") / 2).cast("int")
    edits = F.concat(spans, F.array(F.struct(middle.alias("start"), middle.alias("stop"), F.lit("\n\n").alias("replacement"))))
    trees = token_counts.build_trees(docs.select("doc_id", "text", F.when(F.length("text") > 0, edits).alias("edits")), BYTE_TOKENIZER, edits_col="edits")
    return token_counts.recount(trees, BYTE_TOKENIZER).select("doc_id", "tokens_before", "tokens_after", "n_edits", "encoded_again")


def op6_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive_pages(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, folder, "documents"), repository=F.concat_ws("/", "source", "lang"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit_quality(docs, _table(spark, folder, "labels"), meta_cols=("n_chars",))
    return quality.score_quality(docs, model, meta_cols=("n_chars",))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.identify_language(docs, language.fit_centroids(docs))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, folder, "embeddings"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, folder, "documents")).drop("good")


_ALL = (
    op1_embedding_dups, op2_minhash_dups, op3_url_trust, op4_packing, op5_token_counts, op6_archives, op7_secrets, op8_decontaminate, op9_quality,
    op10_language, op11_centroids, op12_spelling, op13_quality_rules,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _query(f) for f in _ALL}


def oracle_texts() -> dict[str, str]:
    return dict(ORACLES)
