"""Estimates from samples of objects against the whole trace."""

import hashlib
from collections import OrderedDict, defaultdict

import numpy as np
import pytest

from tracewell.operators import sampled

SCHEMA = "vtime bigint, obj_id bigint, obj_size bigint, size int, one int"


def made(seed, n=6000, objects=1500):
    """One object has a third of all requests; popularities of the others fall off; two columns clash with the operators' own."""
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(n) < 0.33, 1, (objects * rng.random(n) ** 3).astype(int) + 10 * seed * objects)
    return [(k + 1, int(ids[k]), int(ids[k]) % 90 + 1, None, None) for k in range(n)]


def misses(ids, size):
    """By object, of an LRU cache."""
    cache, out = OrderedDict(), defaultdict(int)
    for o in ids:
        if o in cache:
            cache.move_to_end(o)
        else:
            out[o] += 1
            cache[o] = None
            if len(cache) > size:
                cache.popitem(last=False)
    return out


def chosen(o, one_in):
    return int(hashlib.md5(str(o).encode()).hexdigest()[:15], 16) % one_in == 0


@pytest.mark.parametrize(("seed", "one_in"), [(1, 4), (2, 10), (3, 1)])
def test_estimates(spark, seed, one_in):
    rows, sizes = made(seed), [100, 300, 1000]
    trace = spark.createDataFrame(rows, SCHEMA)
    got = {r["cache_size"]: r for r in sampled.sampled_curve(trace, sizes, one_in).collect()}
    ids = [r[1] for r in rows]
    part = [o for o in ids if chosen(o, one_in)]
    for c in sizes:
        # A cache of so many sampled objects, rounded up as a distance below c / one_in hits.
        own = misses(part, -(-c // one_in)).values()
        assert got[c]["miss_ratio"] == pytest.approx(one_in * sum(own) / len(ids), abs=1e-6)
        assert got[c]["std_error"] == pytest.approx((one_in * (one_in - 1) * sum(m * m for m in own)) ** 0.5 / len(ids), abs=1e-6)
        exact = sum(misses(ids, c).values()) / len(ids)
        assert abs(got[c]["miss_ratio"] - exact) <= 4 * got[c]["std_error"] + 1e-6
    w = sampled.sampled_working_set(trace, one_in).first()
    objects = {r[1]: r[2] for r in rows}
    picked = [s for o, s in objects.items() if chosen(o, one_in)]
    assert (w["wss_obj"], w["wss_byte"]) == (one_in * len(picked), one_in * sum(picked))
    assert w["wss_byte_error"] == pytest.approx((one_in * (one_in - 1) * sum(s * s for s in picked)) ** 0.5, abs=1e-5)
    assert abs(w["wss_obj"] - len(objects)) <= 4 * w["wss_obj_error"] and abs(w["wss_byte"] - sum(objects.values())) <= 4 * w["wss_byte_error"]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tuple(sampled.sampled_working_set(none, 10).first()) == (0, 0.0, 0, 0.0)
    assert sampled.sampled_curve(none, [10], 10).count() == 0
