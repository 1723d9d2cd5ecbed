"""The pipeline: stages keep the columns of documents and pass clean texts on."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, DATA))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert 0 < docs.count() <= 3 * rows and docs.columns == ["doc_id", "n_ids", "ids", "score"]


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, DATA))
    assert docs.count() == 0
