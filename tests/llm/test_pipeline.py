"""The pipeline against its stages' meaning on a small table."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from locusflow.llm import mixing
from locusflow.llm.common import table

SF = "/root/testdata/sf0.001"


def stage_outputs(spark, tmp_path):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out[name] = docs = spark.read.parquet(str(tmp_path / name))
    return out


def test_stages(spark, tmp_path):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = stage_outputs(spark, tmp_path)
    assert list(out) == ["quality", "near_duplicates", "mixing", "packing"]
    assert all(out[n].columns == docs.columns for n in ("quality", "near_duplicates", "mixing"))
    kept = {r.doc_id for r in out["quality"].collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert good <= kept and len(bad & kept) <= 0.1 * len(bad)
    texts = Counter(r.text for r in out["near_duplicates"].collect())
    assert max(texts.values()) == 1 and {r.doc_id for r in out["near_duplicates"].collect()} <= kept
    size = out["near_duplicates"].agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n
    taken = out["mixing"].agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n
    assert abs(taken - 1.5 * size) <= 0.02 * size
    pieces = out["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in out["mixing"].collect()}
    assert len([r for r in pieces if r.start == 0]) == out["mixing"].count()


def test_run_agrees_with_the_stages(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SF)
    staged = stage_outputs(spark, tmp_path)["packing"]
    pick = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(tuple(r) for r in whole.select(*pick).collect()) == Counter(tuple(r) for r in staged.select(*pick).collect())


def test_empty_documents(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
