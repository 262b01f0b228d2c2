"""Quality rules with DataFrame operations only: counts of words, symbols and repeats, and the log-likelihood ratio of
hashed n-grams between a trusted target and the raw corpus.

Uni- and bigrams are hashed into a fixed number of buckets. Bucket counts of the trusted documents and of all
documents, smoothed, give two multinomials; a document's ratio is the mean over its n-grams of log p_target - log p_raw.
Every document is thresholded in the same way: below the threshold it goes. The trusted documents are those that
`labels` marks with quality 1.

Defined cases: a null or empty text has no words and fails the base rule; without trusted documents all ratios are 0;
repeated labels count a document once; a null doc_id is never trusted; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALL, ASCII_SPACE, broadcast_if_small, words, written

MAX_BROADCAST_TRUSTED = 200_000


@dataclass(frozen=True)
class RuleParams:
    buckets: int = 4096
    smoothing: float = 5.0
    threshold: float = -0.06
    min_words: int = 50
    max_repeat_percent: int = 50


def _next(arr: Column, by: int = 1) -> Column:
    return F.slice(arr, by + 1, ALL)


def _word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _buckets(hashes: Column, n: int) -> Column:
    """Buckets of the words and, after them, of the pairs of neighbours."""
    pairs = F.zip_with(hashes, _next(hashes), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int")))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(n)).cast("int")), F.filter(pairs, lambda b: b.isNotNull()))


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words from hs, the words' hashes: words inside 3-word windows that the text holds twice or more. Steps that are used twice are columns, so that Spark computes each once."""
    hs, windows, placed, starts = (F.col(c) for c in ("hs", "_windows", "_placed", "_starts"))
    triples = F.zip_with(F.zip_with(hs, _next(hs), lambda a, b: F.struct(a, b)), _next(hs, 2), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = rows.withColumn("_windows", F.filter(triples, lambda h: h.isNotNull()))
    rows = rows.withColumn("_placed", F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.zip_with(placed, _next(placed), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    covered = F.zip_with(starts, _next(starts), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_windows", "_placed", "_starts")


def bucket_weights(docs: DataFrame, labels: DataFrame, p: RuleParams) -> DataFrame:
    """One row: array<double> of log p_target - log p_raw for each bucket."""
    trusted = written(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1)), "rules-trusted")
    rows = docs.select("doc_id", "text").join(broadcast_if_small(trusted, trusted.count(), MAX_BROADCAST_TRUSTED), "doc_id", "left")
    hashes = rows.select("trusted", _word_hashes(words(F.col("text"))).alias("hs"))
    counts = hashes.select("trusted", F.explode(_buckets(F.col("hs"), p.buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(p.buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    pairs = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    spread = p.smoothing * p.buckets
    weight = lambda c: F.log((c["target"] + p.smoothing) / (F.col("target") + spread)) - F.log((c["raw"] + p.smoothing) / (F.col("raw") + spread))
    return pairs.select(F.when(F.col("target") > 0, F.transform("all", weight)).otherwise(F.transform("all", lambda c: F.lit(0.0))).alias("weights"))


def rule_columns(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed, kept."""
    weights = written(bucket_weights(docs, labels, p), "rules-weights")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("ws"))
    rows = rows.withColumn("n_words", F.size("ws").cast("long")).withColumn("hs", _word_hashes(F.col("ws"))).withColumn("weights", weights.scalar())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]"))
    got = rows.select(
        "doc_id", "n_words", F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"),
        "hs", "weights",
    )
    got = with_repeated_words(got).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    total = F.aggregate(_buckets(F.col("hs"), p.buckets), F.lit(0.0), lambda s, b: s + F.get(F.col("weights"), b))
    got = got.withColumn("ratio", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0))
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round("ratio", 6).alias("ratio"), failed.alias("base_failed"), (~failed & (F.round("ratio", 6) >= p.threshold)).alias("kept"))
