"""The pipeline's decontamination against a plain Python brute force, on documents that each hold one window of ten words."""

import corpus_pipeline
from test_decontaminate import contaminated, fixture


def test_stage_drops_single_windows(spark, tmp_path):
    docs, items = fixture(60, 11)
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars int")
    after = stage(spark, before, str(tmp_path))
    assert after.columns == before.columns
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in docs} - contaminated(docs, items) == set(range(60, 100))
