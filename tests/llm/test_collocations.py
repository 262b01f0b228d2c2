"""Collocations against plain counting, their trie against a dictionary, and the SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracewell.llm import collocations as co
from tracewell.llm.oracle import ORACLE

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, p):
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= p.min_count}
        longer = Counter()
        for g, a in cand.items():
            for part in (g[:2], g[1:]) if len(g) == 3 else ():
                longer[part] = max(longer[part], a)
        kept = []
        for g, a in cand.items():
            if longer[g] and 100 * longer[g] >= p.cover_percent * a:
                continue
            cuts = [(1000000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        n = sum(a for g, a in own.items() if len(g) == 1)
        out += [(lang, k + 1, g.decode(), -a, left, right, n, -s) for k, (s, a, g, left, right) in enumerate(sorted(kept)[: p.top])]
    return sorted(out)


def collected(df):
    assert df.columns == COLS
    return sorted(tuple(r) for r in df.collect())


def made(seed, n, vocabulary=30):
    """Texts of few words, so that phrases of three repeat; some runs without an end of a piece."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" if k % 3 else f"É{k}-Ñ" for k in range(vocabulary)])
    ends = np.array([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", "!?", "\x0b", "\x0c ", ";:"])
    draw = lambda m: "".join(w + e for w, e in zip(words[np.minimum(rng.geometric(0.15, m) - 1, vocabulary - 1)], ends[rng.integers(0, len(ends), m)], strict=True))
    return [(rng.choice(["en", "de"]), draw(int(rng.integers(0, 400)))) for _ in range(n)]


SMALL = [co.PhraseParams(), co.PhraseParams(min_count=3, top=25, chunk_words=64, trie_entries=40, container_entries=4, partition_entries=50, max_broadcast_words=0)]


@pytest.mark.parametrize("p", SMALL, ids=["usual", "small limits"])
def test_made_texts(spark, p):
    rows = [*made(1, 150), (None, "a b c. " * 12), ("und", "a b c " * 3), ("en", None), ("en", ""), ("fr", " .,\n"), ("xx", " ".join(["Ab", "cd", "\xa0", "\x00e"] * 40_000)), ("xx", "the\x1cend of it " * 30)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, rank int, chunk int").repartition(3)
    assert collected(co.collocations(docs, p)) == plain(rows, p)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "doc_id bigint, lang string, text string")).count() == 0


@pytest.mark.parametrize("limit", [2, 100])
def test_trie_counts_as_a_dictionary(limit):
    rng = np.random.default_rng(limit)
    trie, want, got = co.HatTrie(limit), Counter(), Counter()
    for _ in range(60):
        # One first word and one pair of words dominate.
        ids = np.minimum(rng.geometric(0.3, 500), 40).astype(np.int64)
        ids[rng.integers(0, 500, 40)] = 0
        keys, counts = co.phrases_of(ids, np.ones(500, bool))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        trie.add(keys, counts)
        if trie.used > 300:
            before = trie.used
            for run, n in trie.spill(150):
                assert (np.diff(run) > 0).all()
                got.update(dict(zip(run.tolist(), n.tolist(), strict=True)))
            assert trie.used <= 150 < before
        nodes = [x.keys[x.keys > 0] >> (2 * co.BITS) for x in trie.leaves]
        assert all(len(set((x.keys[x.keys > 0] >> co.BITS).tolist())) == 1 for x in trie.leaves if x.used > limit)
        assert all(x.max() <= y.min() for x, y in zip(nodes, nodes[1:], strict=False) if len(x) and len(y))
    for run, n in trie.spill(0):
        got.update(dict(zip(run.tolist(), n.tolist(), strict=True)))
    assert got == want and trie.used == 0


def test_runs_merge_beyond_packed_numbers():
    rng = np.random.default_rng(3)
    want, rows = Counter(), []
    for _ in range(20):
        ids = rng.choice([3, 1 << 22, 1 << 40], (200, 3))
        keys, n = np.unique(ids, axis=0, return_counts=True)
        want.update({tuple(k): int(c) for k, c in zip(keys.tolist(), n, strict=True)})
        rows += co.run_rows([*keys.T, n], 4).to_pylist()
    got = {}
    for part in range(4):
        own = [(r["n"], r["width"], r["run"]) for r in rows if r["partition"] == part]
        got |= {(r["w1"], r["w2"], r["w3"]): r["a"] for r in (co.merged(own, 10).to_pylist() if own else [])}
    assert got == {k: n for k, n in want.items() if n >= 10}


def test_scores_beyond_64_bits(spark):
    numbers = spark.createDataFrame([("en", "a", 10**13, 1), ("en", "b", 3 * 10**13 + 7, 2)], "lang string, word string, f bigint, rank bigint")
    grams = spark.createDataFrame([(1, 2, 0, 9 * 10**12 + 1)], "w1 bigint, w2 bigint, w3 bigint, a bigint")
    (r,) = co.scored_phrases(grams, numbers, co.PhraseParams()).collect()
    assert r["score"] == 1000000 * (9 * 10**12 + 1) ** 2 // (10**13 * (3 * 10**13 + 7))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    path = f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLE['op11_collocations']})").fetchall()
    assert len(want) > 500 and collected(co.collocations(spark.read.parquet(path))) == sorted(want)
