"""The registered queries against their SQL, and the stages of the pipeline on odd rows and real tables."""

import pytest
from compare import connect, differences

import corpus_pipeline
from landroll.llm import decontaminate, minhash_dups, quality, secret_scan
from landroll.llm.queries import QUERIES, oracle_texts

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, component_id int"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, folder, name):
    assert differences(spark, connect(folder), folder, name, QUERIES[name], oracle_texts().get(name)) == []


def test_stages_on_odd_rows(spark, folder):
    good = "the quiet river ran along the old road and nobody saw it turn that year"
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (None, "no id but some quiet words"), (5, good + " password: hunter22222"), (6, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "k", 1) for i, t in rows], COLUMNS)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            out = stage(spark, table, folder)
            assert out.columns == docs.columns, name
        assert corpus_pipeline.STAGES[4][1](spark, table, folder).count() >= min(1, table.count())
    kept = [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, None, 5, 6], key=str) or sorted(kept, key=str) == sorted([1, 3, 4, None, 6], key=str)
    assert corpus_pipeline.keep_good(spark, docs, folder).columns == docs.columns


def test_run_equals_operators_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), meta_cols=("n_chars",))
    good = {r["doc_id"] for r in quality.score_quality(docs, model, meta_cols=("n_chars",)).where("predicted = 1").collect()}
    left = docs.where(docs.doc_id.isin(sorted(good))).cache()
    first = {r["doc_id"] for r in minhash_dups.near_duplicates(left).where("kept").collect()}
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(left, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed.doc_id) == first - leaked
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert secret_scan.scan_secrets(secret_scan.redact_secrets(left)).where("n_assign + n_access + n_hex > 0").count() == 0
