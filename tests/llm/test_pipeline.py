"""The pipeline's stages on the smallest tables, each against what its operator says about its own input."""

import corpus_pipeline
from tracewell.llm import decontaminate, ngram_join, quality_model
from tracewell.llm.common import read


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), schema=stage_schema(name, before))
        kept[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    start = read(spark, sf_dir, "documents")
    good = {r["doc_id"] for r in quality_model.quality_digest(start, read(spark, sf_dir, "labels")).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept[names[0]].collect()} == good
    comps = {r["component_id"] for r in ngram_join.near_duplicates(kept[names[0]]).collect()}
    assert {r["doc_id"] for r in kept[names[1]].collect()} == comps
    clean = {r["doc_id"] for r in decontaminate.contamination(kept[names[1]], read(spark, sf_dir, "benchmark")).collect() if not r["contaminated"]}
    assert {r["doc_id"] for r in kept[names[2]].collect()} == clean
    words = sum(len(r["text"].split()) for r in kept[names[2]].collect())
    mixed = sum(len(r["text"].split()) for r in kept[names[3]].collect())
    assert abs(mixed - 1.5 * words) < 100
    assert kept[names[4]].count() == kept[names[3]].count()


def stage_schema(name, before):
    return "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" if name.startswith("token") else before.schema
