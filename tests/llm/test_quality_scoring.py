"""Scoring whole groups of texts: n-grams hashed together, words held within the bound, a text sent to Python once."""

import math
import tracemalloc

import numpy as np
import pytest
import xxhash
from tracewell.llm import quality_model
from tracewell.llm.quality_model import ModelParams, features

WORDS = ["a", "ab", "abc", "é", "naïve", "日本語の文", "😀😀😀😀😀", "x😀yé" * 3, "ab\x00cd", "<b>", "w" * 3000]


@pytest.mark.parametrize("p", [ModelParams(), ModelParams(buckets=1000, min_n=1, max_n=17)])
def test_word_sums_are_those_of_the_features(p):
    table = np.random.default_rng(1).normal(size=p.buckets)
    got = quality_model.word_sums(WORDS, table, p)
    assert all(math.isclose(s, math.fsum(table[features(w, p)]), rel_tol=1e-9, abs_tol=1e-9) for w, s in zip(WORDS, got, strict=True))
    assert got == [quality_model.word_sums([w], table, p)[0] for w in WORDS]
    assert [quality_model.n_features(len(w), p) for w in WORDS] == [len(features(w, p)) for w in WORDS]


def test_no_hash_call_for_each_gram(monkeypatch):
    """A new word costs one call of the hash function, however many n-grams it has."""
    calls, plain = [], xxhash.xxh32_intdigest
    monkeypatch.setattr(xxhash, "xxh32_intdigest", lambda x: calls.append(x) or plain(x))
    quality_model.scorer(np.zeros(1 << 16), 0.1, ModelParams())(" ".join(f"someword{k}" for k in range(500)))
    assert len(calls) <= 500


def test_held_words_are_bounded():
    """cache_words of them at most, at under 200 bytes each."""
    p = ModelParams(cache_words=20_000)
    score = quality_model.scorer(np.zeros(p.buckets), 0.1, p)
    score("warm up")
    tracemalloc.start()
    try:
        for k in range(59):
            score(" ".join(f"word{k}x{i}" for i in range(1000)))
        assert tracemalloc.get_traced_memory()[0] < 200 * p.cache_words
    finally:
        tracemalloc.stop()


def test_scores_do_not_depend_on_the_group():
    p = ModelParams(cache_words=7)
    table = np.random.default_rng(2).normal(size=p.buckets)
    texts = [" ".join(WORDS[k:] + WORDS[:3]) for k in range(8)] + [None, "", "b a b"]
    together = quality_model.group_scorer(table, 0.2, p)
    want = [quality_model.scorer(table, 0.2, p)(t) for t in texts]
    assert together(texts) == want == [together([t])[0] for t in texts]
    assert together(["a b b"]) == together(["b a b"]) and together([]) == []


def test_accepted_sends_a_text_once(spark):
    docs = spark.createDataFrame([(1, "some text", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    kept = quality_model.accepted(docs, labels)
    assert sorted(map(tuple, kept.collect())) == [(1, "some text", "a"), (2, None, None)]
    plan = kept._jdf.queryExecution().analyzed().toString()
    # c0 to c2 go to Python, and nothing beside them.
    sent = next(line for line in plan.splitlines()[1:] if "AS c0" in line and "score" not in line)
    assert sent.count(" AS ") == 3


def test_sample_takes_few_bytes(spark):
    """Two bytes a bucket id and as few a count as hold it, with what bag() says."""
    texts = {k: "word " * 400 * (k % 2) + f"text {k}" for k in range(1, 40)} | {40: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id bigint, quality int")
    p = ModelParams()
    got = quality_model.training_rows(docs, labels, p)
    bags = [quality_model.bag(t, p) for t in texts.values()]
    assert {(tuple(i.tolist()), tuple(c.tolist())) for i, c, _ in got} <= {(tuple(i.tolist()), tuple(c.tolist())) for i, c in bags}
    assert len(got) > 20 and all(i.nbytes + c.nbytes <= 4 * len(i) for i, c, _ in got)
