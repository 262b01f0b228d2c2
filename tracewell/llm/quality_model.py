"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed into one table of learned vectors. A document is the mean of the vectors
of all n-grams of all its words; a linear layer and a softmax give the class. Training is stochastic gradient descent in
numpy over a bounded, hash-ordered sample of the labelled documents outside the held-out fold.

The mean is linear, so a word's share of the class score is one number; executors keep it per word and score whole
texts in one pass.

Defined cases: an empty or null text has the score that the output layer gives to no evidence; without training rows
(or with one class only) every score is that class's share, 0.5 without rows; contradicting labels of a document count
as separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Characters of texts that are scored at once (a longer text by itself), words that are hashed at once, and characters of the longest word that is kept.
GROUP, AT_ONCE, LONGEST = 1 << 18, 1 << 14, 64


@dataclass(frozen=True)
class ModelParams:
    buckets: int = 1 << 16
    dim: int = 16
    min_n: int = 3
    max_n: int = 4
    epochs: int = 5
    rate: float = 0.3
    #: A vector's gradient is divided by the document's length; this makes up for some of it.
    vector_gain: float = 30.0
    #: Bound of the sample that training uses, in documents.
    max_train_docs: int = 4000
    threshold: float = 0.3
    seed: int = 17
    #: Words whose scores an executor's worker keeps at most.
    cache_words: int = 250_000


def features(word: str, p: ModelParams) -> list[int]:
    """Buckets of the word and of its character n-grams, word ends marked."""
    marked = f"<{word}>"
    out = [xxhash.xxh32_intdigest(marked) % p.buckets]
    # A very long word (a base64 blob, say) has as many n-grams as characters; all count.
    for n in range(p.min_n, p.max_n + 1):
        out += [xxhash.xxh32_intdigest(marked[i : i + n]) % p.buckets for i in range(len(marked) - n + 1)]
    return out


def n_features(length: int, p: ModelParams) -> int:
    """How many features a word of so many characters has."""
    return 1 + sum(max(0, length + 3 - n) for n in range(p.min_n, p.max_n + 1))


def bag(text: str | None, p: ModelParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    counts: Counter[int] = Counter()
    for word, n in Counter((text or "").split()).items():
        for f in features(word, p):
            counts[f] += n
    return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: ModelParams) -> tuple[np.ndarray, float]:
    """From (buckets, counts, label) the class score of each bucket and the bias: score = sigmoid(mean of bucket scores + bias)."""
    rng = np.random.default_rng(p.seed)
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(p.buckets), float(np.log(share / (1 - share)))
    vectors = rng.normal(0, 0.1, (p.buckets, p.dim)).astype(np.float32)
    out, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    weight = (len(y) / (2 * np.array([(y == 0).sum(), (y == 1).sum()]))).astype(np.float32)
    total, step = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            ids, counts, label = rows[i][0], rows[i][1], int(y[i])
            if not len(ids):
                continue
            # Made anew each time: kept, the shares would take as much room on the driver as the sample.
            share = (counts / max(1.0, counts.sum())).astype(np.float32)
            part = vectors[ids]
            hidden = share @ part
            logits = hidden @ out + bias
            soft = np.exp(logits - logits.max())
            soft /= soft.sum()
            soft[label] -= 1
            soft *= weight[label]
            rate = np.float32(p.rate * (1 - step / total))
            back = out @ soft
            out -= rate * np.outer(hidden, soft)
            bias -= rate * soft
            # A document's buckets differ, so each row is changed once.
            vectors[ids] = part - rate * p.vector_gain * share[:, None] * back
            step += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(float), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, p: ModelParams) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most max_train_docs labelled documents outside the held-out fold, in the order of a hash of the id. Executors make the features; the driver gets the sample only, whatever ids repeat: at most 6 bytes a bucket and document, 1.6 GB if each of 4,000 texts filled all 65,536 buckets, and some 20 MB of texts of a thousand words, as ids and counts take the least bytes that hold them."""
    chosen = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(p.max_train_docs)
    # The sample's size is bounded by max_train_docs, so it may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    id_type = np.min_scalar_type(p.buckets - 1)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [bag(t, p) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [g[0].astype(id_type).tobytes() for g in got], "counts": [g[1].astype(np.min_scalar_type(int(g[1].max(initial=0)))).tobytes() for g in got], "quality": (b["quality"] > 0).astype("int32")})

    made = sample.mapInPandas(bags, "doc_id bigint, ids binary, counts binary, quality int")
    # A label row meets every document of its id, so the bound holds only after the join.
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("ids")).limit(p.max_train_docs).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), bytes(r["ids"]), r["quality"]))
    # Views of what was collected, without a copy.
    return [(ids := np.frombuffer(r["ids"], id_type), np.frombuffer(r["counts"], f"u{len(r['counts']) // max(1, len(ids)) or 1}"), r["quality"]) for r in rows]


def xxh32(columns: list[np.ndarray]) -> np.ndarray:
    """xxh32 (seed 0) of byte strings of one length below 16, a column of uint32 for each of their bytes."""
    p1, p2, p3, p4, p5 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    turn = lambda x, k: x << np.uint32(k) | x >> np.uint32(32 - k)
    h, whole = np.full(len(columns[0]), 374761393 + len(columns), np.uint32), len(columns) // 4 * 4
    for k in range(0, whole, 4):
        a, b, c, d = columns[k : k + 4]
        h = turn(h + (a | b << np.uint32(8) | c << np.uint32(16) | d << np.uint32(24)) * p3, 17) * p4
    for c in columns[whole:]:
        h = turn(h + c * p5, 11) * p1
    h = (h ^ h >> np.uint32(15)) * p2
    h = (h ^ h >> np.uint32(13)) * p3
    return h ^ h >> np.uint32(16)


def word_sums(words: list[str], bucket_scores: np.ndarray, p: ModelParams) -> list[float]:
    """Each word's sum of bucket scores over its features(). The n-grams of all words are hashed together; a word's sum is the same among any others."""
    marked = [f"<{w}>" for w in words]
    sums = bucket_scores[[xxhash.xxh32_intdigest(m) % p.buckets for m in marked]]
    data, sizes = np.frombuffer("".join(marked).encode(), np.uint8), np.fromiter(map(len, marked), np.int64, len(marked))
    # Where characters start in UTF-8, and how many are left from each to its word's end.
    first = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    word = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
    for n in range(p.min_n, p.max_n + 1):
        at = np.flatnonzero(left >= n)
        begin, length, hashes = first[at], first[at + n] - first[at], np.empty(len(at), np.uint32)
        for size in np.flatnonzero(np.bincount(length)).tolist():
            rows = np.flatnonzero(length == size)
            if size < 16:
                hashes[rows] = xxh32([data[begin[rows] + k].astype(np.uint32) for k in range(size)])
            else:
                hashes[rows] = [xxhash.xxh32_intdigest(data[i : i + size].tobytes()) for i in begin[rows].tolist()]
        sums = sums + np.bincount(word[at], bucket_scores[hashes % np.uint32(p.buckets)], len(marked))
    return sums.tolist()


def group_scorer(bucket_scores: np.ndarray, bias: float, p: ModelParams):
    """A function from a list of texts to their scores that keeps words' sums between calls, cache_words at most besides those of the call."""
    held: dict[str, float] = {}

    def scores(texts: list[str | None]) -> list[float]:
        split = [(t or "").split() for t in texts]
        met = set().union(*split)
        new = list(met.difference(held))
        if len(held) + len(new) > p.cache_words:
            held.clear()
            new = list(met)
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            held.update(zip(part, word_sums(part, bucket_scores, p), strict=True))
        out = []
        for words in split:
            # fsum rounds once, so that the sum doesn't depend on the words' order.
            n = sum(k * n_features(length, p) for length, k in Counter(map(len, words)).items())
            out.append(float(1 / (1 + np.exp(-(fsum(map(held.__getitem__, words)) / max(n, 1) + bias)))))
        for w in new:
            if len(w) > LONGEST:
                del held[w]
        return out

    return scores


def scorer(bucket_scores: np.ndarray, bias: float, p: ModelParams):
    """A function from a text to its score."""
    scores = group_scorer(bucket_scores, bias, p)
    return lambda text: scores([text])[0]


def grouped(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in their order, in lists of about GROUP characters."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py())
        size += len(group[-1] or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    yield group


def _scored(docs: DataFrame, labels: DataFrame, p: ModelParams, keep: list[str]) -> DataFrame:
    """The columns to keep as c0, c1, ... (so that no name clashes), and score."""
    spark = docs.sparkSession
    bucket_scores, bias = train(training_rows(docs, labels, p), p)
    model = spark.sparkContext.broadcast((bucket_scores, bias))  # its size is that of the bucket table

    # A text that is kept is sent to Python once.
    place = keep.index("text") if "text" in keep else len(keep)

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = group_scorer(*model.value, p)
        for b in batches:
            scores = pa.array([s for texts in grouped(b.column(place)) for s in score(texts)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], names=[*b.schema.names[: len(keep)], "score"])

    sent = keep if place < len(keep) else [*keep, "text"]
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(sent)])
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", score double"
    return renamed.mapInArrow(score_all, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, p: ModelParams = ModelParams()) -> DataFrame:
    """Per document: doc_id, score, predicted."""
    return _scored(docs, labels, p, ["doc_id"]).select(F.col("c0").alias("doc_id"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return quality_scores(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, p: ModelParams = ModelParams()) -> DataFrame:
    """docs without those that the classifier rejects. Scores are joined to nothing: each row is scored where it is."""
    kept = _scored(docs, labels, p, docs.columns).filter(F.col("score") >= p.threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
