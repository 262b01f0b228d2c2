"""Benchmark decontamination with DataFrame operations only.

A broadcast hash set of the benchmark's word n-grams, packed into a bit array of fixed size, tells which documents may
hold a window. A window of ten words always covers a whole run of five that starts at a multiple of five, so a fifth
of the positions are looked up. Rows that may hold one are verified: their windows meet the benchmark's in a join on
the words themselves, and the hits give word positions and item ids.

Defined cases: null texts have no words; an item without words matches nothing; an item of fewer words than a window
is one window; repeated items and documents count each for themselves (an item_id once); a null item_id is left out of
the ids, though its hits count; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitset import hashed_set, in_set
from .common import ascii_lower, broadcast_if_small, written

WINDOW = 10
ANCHOR = WINDOW // 2
#: Bits of the hashed set, at least and at most (16 MB): a power of two of 16 or more for each n-gram. Beyond the bound the look-up only lets more rows through to the exact join.
SET_BITS, MAX_SET_BITS = 1 << 21, 1 << 27
MAX_BROADCAST_WINDOWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all that isn't ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _grams(ws: Column, n: int, step: int = 1) -> Column:
    """The n-grams that start at multiples of step, each as its words joined by blanks."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n, F.lit(step)), lambda i: F.array_join(F.slice(ws, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _placed_grams(ws: Column, n: int) -> Column:
    return F.transform(_grams(ws, n), lambda w, i: F.struct(F.lit(n).alias("n"), i.alias("at"), w.alias("window")))


def _gram_hashes(ws: Column, n: int, step: int) -> Column:
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n, F.lit(step)), lambda i: F.xxhash64(F.slice(ws, i + 1, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, n (words of the window), window; each once."""
    items = bench.select("item_id", benchmark_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    whole = F.array(F.array_join("ws", " "))
    return items.select("item_id", F.least(F.size("ws"), F.lit(WINDOW)).alias("n"), F.explode(F.when(F.size("ws") < WINDOW, whole).otherwise(_grams(F.col("ws"), WINDOW))).alias("window")).distinct()


def candidate_rows(docs: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as `row`, n_words, and the words where the row may hold a window (else null)."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW values
    grams = windows.select("n", F.split("window", " ").alias("ws"))
    anchors = grams.select(F.explode(F.when(F.col("n") == WINDOW, _gram_hashes(F.col("ws"), ANCHOR, 1)).otherwise(F.array(F.xxhash64("ws")))).alias("h")).distinct()
    anchors = written(anchors, "decon-anchors")
    n_bits = max(SET_BITS, min(MAX_SET_BITS, 1 << (16 * anchors.count()).bit_length()))
    bits = written(hashed_set(anchors, n_bits), "decon-set")
    rows = docs.select(F.struct(*keep).alias("row"), benchmark_words(F.col("text")).alias("ws"))
    rows = rows.select("row", "ws", F.size("ws").cast("long").alias("n_words"))
    looked_up = [_gram_hashes(F.col("ws"), ANCHOR, ANCHOR)] if WINDOW in lengths else []
    looked_up += [_gram_hashes(F.col("ws"), n, 1) for n in lengths if n < WINDOW]
    if not looked_up:
        return rows.select("row", "n_words", F.lit(None).cast("array<string>").alias("ws"))
    rows = rows.withColumn("bits", bits.scalar())
    maybe = F.lit(False)
    for hashes in looked_up:
        maybe = maybe | F.exists(hashes, lambda h: in_set(F.col("bits"), h, n_bits))
    return rows.select("row", "n_words", F.when(maybe, F.col("ws")).alias("ws"))


def find_hits(docs: DataFrame, bench: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as `row`, n_words, hit_words (sorted positions of hit words, from 0), item_ids (sorted as strings)."""
    windows = written(benchmark_windows(bench), "decon-windows")
    rows = written(candidate_rows(docs, windows, keep).withColumn("rid", F.monotonically_increasing_id()), "decon-rows")
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]
    if not lengths:
        return rows.select("row", "n_words", F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("item_ids"))
    candidates = rows.filter("ws is not null").select("rid", "ws")
    grams = F.concat(*[_placed_grams(F.col("ws"), n) for n in lengths])
    each = candidates.select("rid", F.explode(grams).alias("g")).select("rid", F.col("g.at").alias("at"), F.col("g.n").alias("n"), F.col("g.window").alias("window"))
    # A window that many items hold meets a document's words once; its items are looked up by window afterwards.
    only = windows.select("window", "n").distinct()
    hits = written(each.join(broadcast_if_small(only, windows.count(), MAX_BROADCAST_WINDOWS), ["window", "n"]), "decon-hits")
    places = hits.groupBy("rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + n - 1)"))))).alias("hit_words"))
    items = hits.select("rid", "window", "n").distinct().join(windows, ["window", "n"]).select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    found = places.join(items.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("item_ids")), "rid", "left")
    out = rows.select("rid", "row", "n_words").join(found, "rid", "left")
    return out.select("row", "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs, bench, ["doc_id"])
    return hits.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window."""
    hits = find_hits(docs, bench, docs.columns).filter(F.size("hit_words") == 0)
    return hits.select(*[F.col("row")[c].alias(c) for c in docs.columns])
