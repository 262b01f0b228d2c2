"""Stack distances and the LRU curve against brute force, in blocks so small that a trace has many."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.distance import BLOCK, block_length, future_stack_distances, lru_curve, stack_distances


def brute(ids: list[int]) -> list[int]:
    last, out = {}, []
    for at, x in enumerate(ids):
        out.append(len(set(ids[last[x] + 1 : at])) if x in last else -1)
        last[x] = at
    return out


def traces() -> dict[str, list[int]]:
    r = random.Random(5)
    return {
        "hot": [1 if r.random() < 0.34 else r.randrange(60) for _ in range(700)],
        "loop": [k % 37 for k in range(300)],
        "cold": list(range(90)),
        "single": [4],
        "one object": [4] * 50,
    }


def frame(spark, ids):
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(ids)], "vtime bigint, obj_id bigint")


@pytest.mark.parametrize("name", list(traces()))
@pytest.mark.parametrize("block", [16, None])
def test_stack_distances(spark, name, block):
    ids = traces()[name]
    got = {r.vtime: r.stack_dist for r in stack_distances(frame(spark, ids), block).collect()}
    assert [got[k + 1] for k in range(len(ids))] == brute(ids)


def test_curve_and_future(spark):
    ids = traces()["hot"]
    want = brute(ids)
    curve = {r.cache_size: r.miss_ratio for r in lru_curve(frame(spark, ids)).collect()}
    assert curve == {c: round(1 - sum(0 <= d < c for d in want) / len(ids), 6) for c in range(len(set(ids)) + 1)}
    nxt = {r.vtime: r.future_stack_dist for r in future_stack_distances(frame(spark, ids)).collect()}
    for k, x in enumerate(ids):
        later = [j for j in range(k + 1, len(ids)) if ids[j] == x]
        assert nxt[k + 1] == (want[later[0]] if later else -1)


def test_an_empty_trace(spark):
    none = frame(spark, [1]).filter(F.lit(False))
    assert stack_distances(none).count() == 0
    assert lru_curve(none).count() == 0


def test_blocks_grow_with_the_trace():
    assert block_length(0) == BLOCK == block_length(10**9)
    for n in (10**10, 10**12, 10**14):
        assert (n / block_length(n)) ** 2 / 2 <= n / 4
