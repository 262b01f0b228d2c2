"""The LSH forest against comparing all pairs of sets."""

import re

import numpy as np
import pytest

from tracewell.llm import minhash_forest, ngram_join
from tracewell.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, token string, id int, sig string"


def set_of(text):
    ws = WORD.findall((text or "").translate(A_Z))
    return frozenset(zip(ws, ws[1:], strict=False)) or (frozenset([tuple(ws)]) if ws else frozenset())


def links(sets):
    """Pairs of places whose sets link."""
    return [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if s and t and 100 * len(s & t) >= 80 * len(s | t)]


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all rows."""
    ids, sets = [r[0] for r in rows], [set_of(r[1]) for r in rows]
    least = {d: d for d in ids if d is not None}
    pairs = [(ids[i], ids[j]) for i, j in links(sets) if ids[i] is not None and ids[j] is not None]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return sorted(((d, len(s), least.get(d), d is not None and least[d] == d) for d, s in zip(ids, sets, strict=True)), key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def families():
    """Groups of near copies around the threshold, a passage that many otherwise different texts share, and chains whose ends don't link."""
    rng = np.random.default_rng(5)
    out = []
    for f in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 40 + 15 * f)]
        for _ in range(8):
            ws = list(base)
            for at in rng.integers(0, len(ws), rng.integers(0, 5)):
                ws[at] = f"z{rng.integers(0, 99999)}"
            out.append(" ".join(ws))
    shared = " ".join(f"s{i}" for i in range(40))
    out += [f"{shared} " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 9)) for _ in range(40)]
    chain = [f"c{x}" for x in range(60)]
    for k in range(20):
        chain = [*chain[2:], f"d{k}", f"e{k}"]
        out.append(" ".join(chain))
    return [(k + 1, t, None, 0, None) for k, t in enumerate(out)]


@pytest.mark.parametrize("block", [2048, 4])
def test_families(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_COUNT", 4 if block == 4 else 1024)
    p = minhash_forest.ForestParams(block=block, hot_share=3 if block == 4 else 1000)
    rows = families()
    assert collected(minhash_forest.forest_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), p)) == plain(rows)


def test_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert collected(minhash_forest.forest_duplicates(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(spark):
    """Nulls, no words, one word, repeated ids with other texts, a text of a megabyte and its near copy, clashing columns, an empty table."""
    long = " ".join(f"long{i % 9973}x{i % 61}" for i in range(90_000))
    base = [f"w{k}" for k in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, " ".join(base)), (3, " ".join(base[:-1] + ["Other"])), (7, "quite another text"), (9, "Quite another\ntext"), (10, long), (11, long.upper() + " end"), (None, "one"), (None, None), (12, "é ß"), (13, "É ß"), (14, "é ß"), (14, "é ß")]
    rows = [(*r, None, 1, "x") for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert collected(minhash_forest.forest_duplicates(docs)) == plain(rows)
    kept = minhash_forest.one_of_each_forest(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None} | {r[0] for r in plain(rows) if r[3]}
    assert minhash_forest.forest_duplicates(docs.limit(0)).count() == 0


def test_regions_lose_no_link(spark):
    """Pairs at the threshold share least_depth hashes of a tree, all of them in these thousand."""
    p, rng = minhash_forest.ForestParams(), np.random.default_rng(4)
    by = minhash_forest.multipliers(p)
    for _ in range(1000):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (minhash_forest.min_hashes(np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]), by).reshape(p.trees, p.depth) for _ in range(2))
        assert (a[:, : p.least_depth] == b[:, : p.least_depth]).all(1).any()
