"""Bounds and copies: the training sample, buckets of line parts, sources of copies in a mix."""

from collections import Counter

from tracewell.llm import line_dedup, mixing, quality_model


def test_training_sample_is_bounded(spark):
    """Labelled ids that repeat among the documents give no more rows than the bound."""
    docs = spark.createDataFrame([(k % 3, f"text {k} of many") for k in range(600)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)] * 5, "doc_id bigint, quality int")
    p = quality_model.ModelParams(buckets=256, max_train_docs=10)
    first = quality_model.training_rows(docs, labels, p)
    again = quality_model.training_rows(docs.repartition(7), labels, p)
    same = lambda rows: [(i.tolist(), c.tolist(), y) for i, c, y in rows]
    assert len(first) == 10 and same(first) == same(again)


def test_copies_keep_their_sources(spark):
    """Words by source in the mixed documents are those that the mix takes from each source, where sources hold the same rows."""
    text = " ".join(f"w{k}" for k in range(70))
    other = " ".join(f"v{k}" for k in range(300))
    rows = [(1, text, "a"), (1, text, None), (1, text, "a"), (None, text, "b"), (None, text, None), (2, other, "b"), (2, other, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    p = mixing.MixParams(block_words=16)
    got = Counter()
    for r in mixing.mixed_documents(docs, p).collect():
        got[r["source"]] += len(r["text"].split())
    _, sources, _ = mixing.plan_mix(docs, p)
    assert got == {r["source"]: r["take"] for r in sources.collect() if r["take"]}
    assert sum(got.values()) == sum(r["taken"] for r in mixing.taken_words(docs, p).collect())


def test_line_parts_beyond_the_most_buckets(spark):
    """More parts than Spark has buckets for: parts share buckets, and results stay."""
    docs = spark.createDataFrame([(k, f"a line of some length {k % 7}\nanother line, number {k}") for k in range(60)], "doc_id bigint, text string")
    want = sorted(map(tuple, line_dedup.line_digest(docs).collect()))
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert sorted(map(tuple, line_dedup.line_digest(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
