"""Byte caches, residencies, shares and expiry against replaying the trace in a loop."""

import math
from collections import Counter, OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import lru, residency, weighted


def made(seed, n, objects=40, span=5):
    """(vtime, clock_time, obj_id, obj_size, ttl, ns): one object has a third of all requests; sizes change; some requests share a second."""
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(n) < 0.33, 1, rng.integers(1, objects, n))
    times = np.cumsum(rng.integers(0, span, n)) + 1000
    return [(k + 1, int(times[k]), int(ids[k]), int(rng.integers(1, 90)), int(rng.choice([0, 0, 10, 40, 200])), int(ids[k]) % 3) for k in range(n)]


SCHEMA = "vtime bigint, clock_time bigint, obj_id bigint, obj_size bigint, ttl int, ns int"


def replay(rows, capacity, room, expire=False):
    """What an LRU cache does: (hits by vtime, residencies as [obj, from, last, evicted, accesses, room], expired)."""
    cache, first, hits, done, expired = OrderedDict(), {}, {}, [], 0
    for v, t, o, size, ttl, _ in rows:
        w = room(first.setdefault(o, size))
        if o in cache and expire and cache[o]["end"] is not None and t > cache[o]["end"]:
            del cache[o]
            expired += 1
        hits[v] = o in cache
        if o in cache:
            cache.move_to_end(o)
            cache[o]["row"][2], cache[o]["row"][4] = v, cache[o]["row"][4] + 1
        elif w <= capacity:
            while sum(x["row"][5] for x in cache.values()) + w > capacity:
                cache.popitem(last=False)[1]["row"][3] = v
            row = [o, v, v, None, 1, w]
            done.append(row)
            cache[o] = {"row": row, "end": t + ttl if ttl > 0 else None}
    return hits, done, expired


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


HELD = ("obj_id", "from_vtime", "last_vtime", "evicted_at", "n_access", "room")


@pytest.mark.parametrize(("overhead", "block"), [(0, None), (16, 16)])
def test_byte_caches(spark, overhead, block, monkeypatch):
    rows, sizes = made(1, 500), [5, 60, 300, 900, 1500, 10**6]
    if block:
        monkeypatch.setattr(weighted, "block_length", lambda n: block)
    trace = spark.createDataFrame(rows, SCHEMA)
    got = weighted.byte_distances(trace, sizes, overhead)
    for k, c in enumerate(sizes):
        hits, _, _ = replay(rows, c, lambda s: s + overhead)
        assert collected(got.select("vtime", weighted.byte_hit(k, c).alias("hit")), "vtime", "hit") == sorted(hits.items(), key=repr)
    first = {}
    for _, _, o, s, _, _ in rows:
        first.setdefault(o, s)
    for r in weighted.byte_misses(got, sizes).collect():
        hits, _, _ = replay(rows, r["cache_size"], lambda s: s + overhead)
        missed = [first[x[2]] for x in rows if not hits[x[0]]]
        assert r["n_miss"] == len(missed) and r["n_req"] == len(rows)
        assert math.isclose(r["byte_miss_ratio"], sum(missed) / sum(first[x[2]] for x in rows), abs_tol=1e-6)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_residencies(spark, size):
    rows = made(2, 400)
    trace = spark.createDataFrame(rows, SCHEMA)
    _, want, _ = replay(rows, size, lambda s: 1)
    held = residency.residencies(residency.cached_rows(trace, size), size)
    assert collected(held, *HELD) == sorted(map(tuple, want), key=repr)
    power = lambda x: math.ceil(math.log(x) / math.log(1.08))
    stats = Counter((k, b) for _, a, z, e, n, _ in want if e for k, b in (("age", power(e - a)), ("idle", power(e - z)), ("freq", n)))
    assert {(r["kind"], r["bucket"]): r["cnt"] for r in residency.eviction_statistics(held).collect()} == stats


@pytest.mark.parametrize(("size", "overhead"), [(50, 0), (400, 16), (10**6, 0)])
def test_byte_residencies(spark, size, overhead):
    """Some objects are larger than the smallest cache; one insertion may throw out several."""
    rows = made(3, 400)
    _, want, _ = replay(rows, size, lambda s: s + overhead)
    held = residency.residencies(residency.cached_byte_rows(spark.createDataFrame(rows, SCHEMA), size, overhead), size)
    assert collected(held, *HELD) == sorted(map(tuple, want), key=repr)


def test_shares(spark):
    rows, size, interval = made(4, 300), 9, 70
    trace = spark.createDataFrame(rows, SCHEMA)
    _, want, _ = replay(rows, size, lambda s: 1)
    source = {r[0]: r[5] for r in rows}
    held = residency.residencies(residency.cached_rows(trace, size), size)
    got = {(r["interval"], r["source"]): (r["cached"], r["useful"], r["share"]) for r in residency.cache_shares(held, trace.select("vtime", F.col("ns").alias("source")), len(rows), interval).collect()}
    assert len(got) == 3 * 5
    for (i, s), (cached, useful, share) in got.items():
        end = (i + 1) * interval
        own = [r for r in want if r[1] <= end and (r[3] is None or r[3] > end)]
        mine = [r for r in own if source[r[1]] == s]
        assert cached == len(mine) and useful == sum(r[2] > end for r in mine) and math.isclose(share, len(mine) / len(own), abs_tol=1e-6)


@pytest.mark.parametrize("seed", [5, 6])
def test_expiry(spark, seed):
    rows, sizes = made(seed, 500, objects=12, span=9), [2, 6, 100]
    got = {r["cache_size"]: (r["n_req"], r["n_miss"], r["n_expired"]) for r in residency.expiring_misses(spark.createDataFrame(rows, SCHEMA), sizes).collect()}
    for c in sizes:
        hits, _, expired = replay(rows, c, lambda s: 1, expire=True)
        assert got[c] == (len(rows), sum(not h for h in hits.values()), expired), c


def test_expiry_is_strict(spark):
    """An object is still there at its expiry, and gone a second later."""
    rows = [(1, 100, 1, 1, 10, 0), (2, 110, 1, 1, 10, 0), (3, 111, 1, 1, 0, 0), (4, 999, 1, 1, 5, 0)]
    (r,) = residency.expiring_misses(spark.createDataFrame(rows, SCHEMA), [3]).collect()
    assert (r["n_miss"], r["n_expired"]) == (2, 1)


def test_second_sightings_and_warmup(spark):
    rows = made(7, 400)
    trace = spark.createDataFrame(rows, SCHEMA)
    seen, again = set(), []
    for r in rows:
        if r[2] in seen:
            again.append(r)
        seen.add(r[2])
    hits, _, _ = replay(again, 10, lambda s: 1)
    (r,) = lru.lru_misses(lru.second_sightings(trace), [10]).collect()
    assert r["n_miss"] == len(rows) - sum(hits.values())
    hits, _, _ = replay(rows, 10, lambda s: 1)
    late = [h for v, h in hits.items() if v > 100 and rows[v - 1][1] - rows[0][1] >= 300]
    d = lru.distances_with_sizes(trace).join(trace.select("vtime", (F.col("clock_time") - rows[0][1]).alias("t")), "vtime")
    (r,) = lru.lru_misses(lru.after_warmup(d, 100, 300), [10]).collect()
    assert (r["n_req"], r["n_miss"]) == (len(late), len(late) - sum(late))


def test_empty_traces(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert weighted.byte_misses(weighted.byte_distances(none, [5]), [5]).count() == 0
    assert residency.residencies(residency.cached_rows(none, 3), 3).count() == 0
    assert residency.expiring_misses(none, [3]).count() == 0


def test_following(spark):
    """The first point at the same place or later, over several partitions, many of them without points."""
    rng = np.random.default_rng(9)
    queries, points = [(int(x), k) for k, x in enumerate(rng.integers(0, 1000, 300))], [(int(x), k) for k, x in enumerate(rng.choice(900, 12, replace=False))]
    got = residency.following(spark.createDataFrame(queries, "x bigint, q bigint"), spark.createDataFrame(points, "x bigint, p bigint"), "x").collect()
    assert len(got) == 300
    for r in got:
        later = [x for x, _ in points if x >= r["x"]]
        assert (r["point"]["x"] if r["point"] else None) == (min(later) if later else None)
