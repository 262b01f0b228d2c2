"""Removing lines that other documents hold as well, with DataFrame operations only.

Hashes of line keys are range-partitioned, with the document and the position as secondary sort keys, so that a very
common line spreads over as many partitions as it needs. The partitions are kept as buckets of a table; each is read
back sorted, and its first occurrences come from one pass over the sorted rows, without another exchange. A hash can
go on in the next partition; such hashes are at most one for each partition, and a small table of them corrects the
first documents. What comes back per document is a bitmap of the lines that go (64 lines a word, words without such
lines left out), never the lines.

Defined cases: a null or empty text is one empty line; a null doc_id counts as larger than all others; rows that
repeat a doc_id are parts of one document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bit, bucketed, discard, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """A row per line whose key is long enough: two 64-bit hashes of the key, the document, the position."""
    each = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = each.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return key.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "text_hash", "pos")


def first_documents(lines: DataFrame) -> DataFrame:
    """Adds first_doc: the smallest document that holds the line (null if only documents without id do)."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_document = [F.col("doc").asc_nulls_last(), F.col("pos")]
    ranged = lines.repartitionByRange(n, "h1", "h2", *by_document).withColumn("part", F.spark_partition_id())
    # Parts fall into buckets by a hash, so there are more buckets than parts, up to the most that Spark allows; beyond that several whole parts share one.
    most = int(lines.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    held = bucketed(ranged, "line-parts", min(2 * n, most), "part")
    streamed = held.withColumn("first_here", F.first("doc").over(Window.partitionBy("part", "h1", "h2").orderBy(*by_document)))
    ends = held.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))
    crossing = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("key")).groupBy("key").count().filter("count > 1").select("key.h1", "key.h2")
    # At most one key for each partition.
    firsts = written(held.join(F.broadcast(crossing), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("first_of_all")), "line-crossing")
    return streamed.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn("first_doc", F.coalesce("first_of_all", "first_here")).drop("part", "first_here", "first_of_all")


def drop_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: doc, text_hash, n_dropped, and a map from word index to a word of 64 drop bits."""
    # The texts are read once for this table; sampling and sorting work on hashes only.
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    seen = first_documents(lines)
    discard(lines)
    gone = seen.filter((F.col("doc") > F.col("first_doc")) | (F.col("doc").isNull() & F.col("first_doc").isNotNull()))
    bits = bit(F.col("pos") % 64)
    word = F.struct(F.floor(F.col("pos") / 64).cast("int").alias("word"), bits.alias("bits"))
    return (
        gone.select("doc", "text_hash", word.alias("w"))
        .groupBy("doc", "text_hash", F.col("w.word").alias("word")).agg(F.bit_or("w.bits").alias("bits"))
        .groupBy("doc", "text_hash").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("drops"))
    )


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, the text without the lines that the bitmaps name."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("hash"))
    joined = rows.join(bitmaps, F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    # `lines` and `positions` are used more than once, so that Spark computes them once a row.
    joined = joined.withColumn("lines", _lines(F.col("row.text"))).withColumn("n_lines", F.size("lines").cast("long"))
    dropped = F.flatten(F.transform(F.map_entries("drops"), lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["value"], b) == 1, w["key"] * 64 + b)), lambda p: p.isNotNull())))
    joined = joined.withColumn("kept", F.when(F.col("drops").isNotNull(), F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), dropped)))
    kept = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("kept").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(kept)
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")], "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), text.alias("kept_text"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return without_lines(docs, drop_bitmaps(docs, min_chars))


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
