"""Importance resampling against plain loops over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tracewell.llm import resampling
from tracewell.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    ws = WORD.findall((text or "").translate(A_Z))
    return [zlib.crc32(x.encode()) % n for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]], len(ws)


def plain(docs, target, p):
    own = [(d, *features(t, p.buckets)) for d, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in features(x, p.buckets)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + p.buckets) / ((s[b] + 1) * (all_t + p.buckets)))) for b in range(p.buckets)]
    rows = []
    for d, f, w in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w])
    may = sorted((r for r in rows if r[5] >= p.min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: p.percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_resampled_documents(spark, sf_dir):
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    p = resampling.ResampleParams()
    got = resampling.resampled(docs, bench, p)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()], p)
    assert collected(got) == want
    taken = resampling.drawn_documents(docs, bench, p)
    assert taken.columns == docs.columns and sorted(r["doc_id"] for r in taken.collect()) == sorted(r[0] for r in want if r[4])


@pytest.mark.parametrize("hot_share", [1000, 2])
def test_awkward_rows(spark, hot_share):
    """Nulls, no words, copies of lines within and across documents, ties, a text of a megabyte, columns that clash; lines met by broadcast and by a join."""
    long = "\n".join(f"Line {k % 50} of many wörds, {k}" for k in range(40_000))
    same = "one two three\nFour five six\r\n\n , \nseven " * 3
    rows = [(1, None, "k"), (2, "", "k"), (3, " .\n,", "k"), (4, "word", "k"), (5, same, "k"), (6, same, "k"), (6, same, "k"), (None, same, "k"), (7, long, "k"), (8, "ÀB\x7fcd é\nÀB " * 11, "k"), (9, "A\nB\nA\nb\na", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(3)
    target = [("one two three\nfour", 1), (None, 2), ("Àb", 3)]
    p = resampling.ResampleParams(buckets=50, hot_share=hot_share, min_words=5, percent=60)
    want = plain([r[:2] for r in rows], [r[0] for r in target], p)
    assert collected(resampling.resampled(docs, spark.createDataFrame(target, "text string, rid int"), p)) == want


def test_empty_tables(spark):
    p = resampling.ResampleParams(buckets=50, min_words=1)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    docs = [(k, "some words here\n" * k) for k in range(6)]
    assert resampling.resampled(empty, empty, p).count() == 0
    assert collected(resampling.resampled(spark.createDataFrame(docs, empty.schema), empty, p)) == plain(docs, [], p)
