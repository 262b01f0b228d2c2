"""The probability graph and associations against loops that remember the last requests."""

from collections import Counter, deque

import numpy as np
import pytest

from tracewell.operators import association

SCHEMA = "vtime bigint, obj_id bigint, block int, weight string"


def made(seed, n, objects):
    """One object has a third of all requests; runs of four objects come again and again. Two columns clash with the operators' own."""
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(n) < 0.33, 1, rng.integers(0, objects, n))
    for k in range(0, n - 10, 25):
        ids[k : k + 4] = 1000 + 4 * (k // 25 % 7) + np.arange(4)
    return [(k + 1, int(ids[k]), None, "x") for k in range(n)]


def graph_by_loop(rows, lookahead, percent):
    past, weights, totals = deque(), Counter(), Counter()
    for v, o, *_ in rows:
        past.append(o)
        if len(past) > lookahead:
            a = past.popleft()
            for b in past:
                weights[a, b] += 1
                totals[a] += 1
    return {(a, b, n, round(n / totals[a], 6)) for (a, b), n in weights.items() if 100 * n > percent * totals[a]}


@pytest.mark.parametrize(("n", "lookahead", "percent", "block"), [(900, 20, 5, 64), (900, 20, 5, 1 << 16), (400, 3, 30, 16), (400, 7, 0, 5), (20, 20, 5, 64)])
@pytest.mark.parametrize("few", [True, False])
def test_graph(spark, monkeypatch, n, lookahead, percent, block, few):
    monkeypatch.setattr(association, "BROADCAST_ROWS", 10**6 if few else 0)
    rows = made(n, n, 60)
    got = association.probability_graph(spark.createDataFrame(rows, SCHEMA), lookahead, percent, block).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert {tuple(r) for r in got} == graph_by_loop(rows, lookahead, percent)


def test_only_candidates_leave_their_blocks(spark):
    """Counts within a block need no exchange but that of the blocks."""
    counts = association.follow_counts(spark.createDataFrame(made(1, 300, 30), SCHEMA), 5, 64)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def mined_by_loop(rows, lookahead, least, most, confidence):
    times = {}
    for v, o, *_ in rows:
        times.setdefault(o, []).append(v)
    table = sorted((ts, o) for o, ts in times.items() if least <= len(ts) <= most)
    out = set()
    for i, (a, x) in enumerate(table):
        first = True
        for b, y in table[i + 1 :]:
            if b[0] - a[0] > lookahead:
                break
            if abs(len(a) - len(b)) > confidence:
                continue
            shorter = min(len(a), len(b))
            linked, first = first, False
            linked = linked or shorter == 1 and b[0] - a[0] == 1
            far = sum(abs(a[k] - b[k]) > lookahead for k in range(1, shorter))
            linked = linked or any(abs(a[k] - b[k]) == 1 for k in range(1, shorter))
            if linked and far <= confidence:
                out.add((x, y, far))
    return out


@pytest.mark.parametrize(("lookahead", "least", "most", "confidence", "block"), [(20, 2, 8, 1, 64), (20, 2, 8, 1, 1 << 16), (40, 1, 5, 0, 32), (200, 3, 6, 2, 100)])
def test_associations(spark, lookahead, least, most, confidence, block):
    rows = made(5, 1000, 160)
    got = association.associations(spark.createDataFrame(rows, SCHEMA), lookahead, least, most, confidence, block).collect()
    want = mined_by_loop(rows, lookahead, least, most, confidence)
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert association.probability_graph(none).count() == association.associations(none).count() == 0
