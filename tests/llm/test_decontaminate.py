"""Decontamination where the hashes of anchors and short items are negative, and on the sf0.1 documents against the registered SQL."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bitset, decontaminate
from tracewell.llm.oracle import ORACLE

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LARGE = "/root/testdata/sf0.1"


def contaminated(docs, items):
    """Ids of the documents that hold a window of an item, by lists of words."""
    windows = set()
    for _, text in items:
        ws = SPLIT.findall(text.lower())
        n = min(10, len(ws))
        windows |= {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    found = set()
    for i, text in docs:
        ws = SPLIT.findall(text.lower())
        found |= {i for n in {len(w) for w in windows} for k in range(len(ws) - n + 1) if tuple(ws[k : k + n]) in windows}
    return found


def hashes(spark, grams):
    """xxhash64 of arrays of words, as the look-up takes it."""
    return [r["h"] for r in spark.createDataFrame([(k, g) for k, g in enumerate(grams)], "k int, ws array<string>").select("k", F.xxhash64("ws").alias("h")).orderBy("k").collect()]


def fixture(n, seed):
    """n items of 30 words, and a document for each that holds one window of exactly ten words at some offset, among words of its own."""
    rng = random.Random(seed)
    items, docs = [], []
    for i in range(n):
        ws = [f"b{i}x{rng.randrange(10**6)}" for _ in range(30)]
        at, before = rng.randrange(21), rng.randrange(12)
        items.append((i, " ".join(ws)))
        docs.append((i, " ".join([f"d{i}x{k}" for k in range(before)] + ws[at : at + 10] + [f"e{i}x{k}" for k in range(7)])))
    docs += [(n + i, " ".join(f"clean{i}x{k}" for k in range(40))) for i in range(20)]
    # nine words of an item are not a window
    docs += [(n + 20 + i, " ".join(items[i][1].split()[3:12] + ["other"] * 9)) for i in range(20)]
    return docs, items


def test_single_windows(spark):
    docs, items = fixture(60, 7)
    # of the documents, those with one aligned anchor whose hash is negative
    aligned = [[ws[k : k + 5] for k in range(0, len(ws) - 4, 5) if all(w.startswith("b") for w in ws[k : k + 5])] for ws in (t.split() for _, t in docs[:60])]
    single = [a[0] for a in aligned if len(a) == 1]
    assert sum(h < 0 for h in hashes(spark, single)) >= 10
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect() if r["contaminated"]} == contaminated(docs, items) == set(range(60))
    assert {r["n_hit"] for r in got.filter("contaminated").collect()} == {10}


def test_short_items(spark):
    items = [(i, " ".join(f"s{i}x{k}" for k in range(1 + i % 9))) for i in range(45)]
    docs = [(i, f"before {text} after") for i, text in items] + [(100, "before after"), (101, "s9 x0")]
    assert sum(h < 0 for h in hashes(spark, [t.split() for _, t in items])) >= 10
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect() if r["contaminated"]} == contaminated(docs, items) == set(range(45))


def test_slots_are_places_in_the_set(spark):
    some = spark.createDataFrame([(h,) for h in (-1, -(2**63), 2**63 - 1, 0, -1659003, 12345)], "h bigint")
    got = [r["s"] for r in some.select(F.array(*bitset._slots(F.col("h"), decontaminate.SET_BITS)).alias("s")).collect()]
    assert all(0 <= x < decontaminate.SET_BITS for s in got for x in s)
    assert bitset.hashed_set(some, decontaminate.SET_BITS).select(F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x)).alias("n")).first()["n"] == len({x for s in got for x in s})


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="sf0.1 is not here")
def test_sf01_against_sql(spark):
    read = lambda t: spark.read.parquet(f"{LARGE}/{t}.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGE}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op7_decontaminate']})").fetchall()
    got = [tuple(r[c] for c in cols) for r in decontaminate.contamination(read("documents"), read("benchmark")).collect()]
    assert sorted(got) == sorted(want)
