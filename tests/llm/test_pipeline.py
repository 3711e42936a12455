"""The pipeline's stages: columns, decisions, and the whole run."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = [before]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name in ("language_id", "line_dedup", "near_dup"):
            assert counts[-1] <= counts[-2]
            assert docs.select("doc_id").distinct().count() == counts[-1]
        if name == "near_dup":
            assert docs.groupBy("text").count().where("text <> '' and count > 1").count() == 0
    assert docs.selectExpr("sum(length) s").first().s > 0


def test_stages_on_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
