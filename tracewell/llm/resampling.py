"""Target-distribution importance resampling over hashed word uni- and bigrams.

Texts are cut into lines at the newline, which no word holds. A line that many documents share is one row of a table of
distinct lines: its features are hashed once, and their counts are multiplied by the line's occurrences. What lines leave
out are the bigrams across their ends; those are hashed per document and added. Bucket counts of the corpus and of the
target give each bucket's gain; a distinct line's gains are summed once and meet the documents that hold it by a digest of
the line. Lines with a thousandth of all occurrences or more (a thousand at most) are broadcast, so no line's rows meet
in one task. The draw adds a Gumbel number made from the document's id, and takes the highest scores.

Defined cases: a null text, or one without words, has no features and weight 0; a line without words counts as if it were
not there; rows that repeat a doc_id are weighed and drawn each; a null doc_id counts as an empty one in the random number
and comes last in ties; an empty target or corpus has count 0 in every bucket; an empty table gives an empty result. A
very long text or line is one row like any other; its features are hashed in one pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, ranked, written

#: Lower-cased bytes of a word: digits, letters, and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HAS_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class ResampleParams:
    buckets: int = 10_000
    #: Documents of at least so many words are drawn from, and so many of a hundred are drawn.
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    #: A line with one of so many occurrences is broadcast; there are no more such lines than that.
    hot_share: int = 1000


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERED)


def line_buckets(words: list[bytes], n: int) -> list[int]:
    """Buckets of a line's words and of its pairs of consecutive words."""
    crcs = [zlib.crc32(w) for w in words]
    pairs = [zlib.crc32(w, zlib.crc32(b" ", c)) for w, c in zip(words[1:], crcs, strict=False)]
    return [c % n for c in crcs] + [c % n for c in pairs]


def _kept(buckets: list[int], n: int) -> bytes:
    return np.array(buckets, np.uint16 if n <= 1 << 16 else np.uint32).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64)


def line_table(texts: DataFrame, p: ResampleParams) -> DataFrame:
    """A row for each distinct line with words: key (a digest), occ (how often it occurs), n (its features), buckets (theirs)."""
    lines = texts.select(F.explode(F.split(ascii_lower(F.col("text")), "\n")).alias("line")).filter(F.col("line").rlike(HAS_WORD)).groupBy("line").agg(F.count("*").alias("occ"))

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_py().encode("utf-8", "surrogatepass") for x in b.column("line")]
            found = [line_buckets(WORD.findall(x), p.buckets) for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), b.column("occ"), pa.array([len(x) for x in found], pa.int64()), pa.array([_kept(x, p.buckets) for x in found], pa.binary())], names=["key", "occ", "n", "buckets"])

    return lines.mapInArrow(hash_lines, "key binary, occ bigint, n bigint, buckets binary")


def document_table(docs: DataFrame, p: ResampleParams) -> DataFrame:
    """rid, doc_id, keys (digests of the text's lines with words, in order), cross (buckets of the bigrams from each such line to the next)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, cross = [], []
            for text in b.column("text"):
                own, across, last = [], [], None
                for line in lowered(text.as_py()).split(b"\n"):
                    words = WORD.findall(line)
                    if not words:
                        continue
                    own.append(xxhash.xxh3_128_digest(line))
                    if last is not None:
                        across.append(zlib.crc32(last + b" " + words[0]) % p.buckets)
                    last = words[-1]
                keys.append(own)
                cross.append(_kept(across, p.buckets))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(keys, pa.list_(pa.binary())), pa.array(cross, pa.binary())], names=["rid", "doc_id", "keys", "cross"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(cut, f"rid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, keys array<binary>, cross binary")


def bucket_counts(lines: DataFrame, rows: DataFrame, p: ResampleParams) -> DataFrame:
    """(bucket, n): how often the bucket's features occur, from distinct lines times their occurrences and from the bigrams across lines. Each task adds up its own; every bucket has a row a task at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            each = [_read(data, p.buckets) for data in b.column("data").to_pylist()]
            if each:
                np.add.at(total, np.concatenate(each), np.repeat(b.column("times").to_numpy(), [len(x) for x in each]))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    both = lines.select(F.col("occ").alias("times"), F.col("buckets").alias("data")).unionByName(rows.select(F.lit(1).cast("long").alias("times"), F.col("cross").alias("data")))
    return both.mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, p: ResampleParams) -> list[int]:
    """Each bucket's gain in thousandths of a nat; as many numbers as there are buckets, whatever the corpus. source, target: (bucket, n)."""
    counts = []
    for table in (source, target):
        n = [0] * p.buckets
        for r in table.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    all_s, all_t = map(sum, counts)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_s + p.buckets) / (float(s + 1) * float(all_t + p.buckets)))) for s, t in zip(*counts, strict=True)]


def _gain_sums(table: DataFrame, data: str, keep: list[str], every: list[int], p: ResampleParams) -> DataFrame:
    """The columns to keep, and gain: the sum over the row's buckets."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(np.array(every, np.int64))  # one number a bucket

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            sums = [int(of[_read(x, p.buckets)].sum()) for x in b.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sums, pa.int64())], names=[*keep, "gain"])

    schema = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep) + ", gain bigint"
    return table.select(*keep, data).mapInArrow(add, schema)


def document_weights(docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """A row for each of docs: rid, doc_id, n_features, n_words, weight. docs: doc_id, text; target: text."""
    lines = written(line_table(docs, p), "resample-lines", compression="zstd")
    rows = written(document_table(docs, p), "resample-documents")
    none = target.select(F.lit(0).alias("doc_id"), "text")
    every = gains(bucket_counts(lines, rows, p), bucket_counts(line_table(target, p), document_table(none, p), p), p)
    of_line = written(_gain_sums(lines, "buckets", ["key", "occ", "n"], every, p), "resample-gains")
    uses = rows.select("rid", F.explode("keys").alias("key"))
    n_uses = of_line.agg(F.sum("occ")).first()[0] or 0
    hot = F.col("occ") * p.hot_share >= F.lit(n_uses)
    # Each of these lines has one in hot_share of all occurrences, so there are at most hot_share of them.
    met = uses.join(F.broadcast(of_line.filter(hot).select("key", F.col("gain").alias("hot_gain"), F.col("n").alias("hot_n"))), "key", "left")
    common = met.filter("hot_n is not null").select("rid", F.col("hot_gain").alias("gain"), F.col("hot_n").alias("n"))
    other = met.filter("hot_n is null").select("rid", "key").join(of_line.filter(~hot).select("key", "gain", "n").hint("merge"), "key").select("rid", "gain", "n")
    # The bigrams across lines are the row's own, and keep rows without lines.
    width = 2 if p.buckets <= 1 << 16 else 4
    own = _gain_sums(rows.withColumn("n", F.floor(F.length("cross") / width)), "cross", ["rid", "doc_id", "n"], every, p)
    of_lines = common.unionByName(other).groupBy("rid").agg(F.sum("gain").alias("line_gain"), F.sum("n").alias("line_n"))
    joined = own.join(of_lines, "rid", "left").select("rid", "doc_id", (F.col("n") + F.coalesce("line_n", F.lit(0))).alias("n_features"), (F.col("gain") + F.coalesce("line_gain", F.lit(0))).alias("gain"))
    # A text of W words has W words and W - 1 pairs. pmod makes the division of whole numbers go down.
    down = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return joined.select("rid", "doc_id", "n_features", F.floor((F.col("n_features") + 1) / 2).alias("n_words"), F.when(F.col("n_features") > 0, down).otherwise(0).cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths from the id, as a long."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1 for the first drawn; null if it is not drawn)."""
    weights = document_weights(docs.select("doc_id", "text"), target.select("text"), p)
    scored = written(weights.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), p.seed)), "resample-scores")
    may = scored.filter(F.col("n_words") >= p.min_words)
    n = p.percent * may.count() // 100
    placed = ranked(may.select("rid", "score", "doc_id"), "resample-order", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")).filter(F.col("rank") <= n)
    return scored.join(placed.select("rid", "rank"), "rid", "left").select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """The rows of docs that the draw takes, as they are; of rows that repeat a doc_id, all or none."""
    taken = resampled(docs, target, p).filter("rank is not null").select("doc_id").distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["doc_id"]), "left_semi")
