"""Future reuse of writes, hit-ratio heatmaps and trimmed means against plain loops."""

import random

from pyspark.sql import functions as F

from tracewell.operators import analytics as an
from tracewell.operators.distance import stack_distances

OPS = ["get", "gets", "set", "cas", "delete", "add", "incr"]


def requests(n=400, seed=3):
    r, t, out = random.Random(seed), 0, []
    for v in range(1, n + 1):
        t += r.choice([0, 1, 30, 4000])
        out.append((v, t, r.choice([1, 1, 2, 3, r.randrange(20)]), r.choice(OPS)))
    return out


def future_reuse(rows):
    live, out = {}, {}
    for i, (_, t, x, op) in enumerate(rows):
        later = next((o for _, _, y, o in rows[i + 1 :] if y == x), None)
        reused = op not in ("set", "delete") and later is not None and later not in ("set", "cas", "delete")
        if x in live:
            wrote, seen, freq = live[x]
            if op == "set":
                seen, freq = None, 0
            age = t - wrote
            key = (age if age < 3600 else age // 5 * 5, reused)
            c, f, a = out.get(key, (0, 0, 0))
            out[key] = (c + 1, f + freq, a + (t - seen if seen is not None else 0))
        if op == "set":
            live[x] = (t, None, 0)
        elif op == "delete":
            live.pop(x, None)
        elif x in live and op in ("get", "gets", "incr"):
            live[x] = (live[x][0], t, live[x][2] + 1)
    return out


def test_write_future_reuse(spark, monkeypatch):
    rows = requests()
    trace = spark.createDataFrame(rows, "vtime bigint, t bigint, obj_id bigint, op string")
    for length in (an.SLICE, 16):
        monkeypatch.setattr(an, "SLICE", length)
        got = {(r.age, r.reused): (r.cnt, r.sum_freq, r.sum_access_age) for r in an.write_future_reuse(trace).collect()}
        assert got == future_reuse(rows)
    assert an.write_future_reuse(trace.filter(F.lit(False))).count() == 0


def test_hit_ratio_heatmaps(spark):
    ids = [x for _, _, x, _ in requests()]
    trace = spark.createDataFrame([(k + 1, x) for k, x in enumerate(ids)], "vtime bigint, obj_id bigint")
    d = stack_distances(trace)

    def hits(start, end, size):
        """Hits of an LRU list that is empty at the start."""
        kept, out = [], []
        for x in ids[start:end]:
            out.append(x in kept)
            kept = [x] + [y for y in kept if y != x]
            del kept[size:]
        return out

    got = {(r.start_interval, r.end_interval): r.hit_ratio for r in an.heatmap_hit_ratio_window(d, 4, 100).collect()}
    want = {(s, e): round(sum(h := hits(s * 100, (e + 1) * 100, 4)) / len(h), 6) for s in range(4) for e in range(s, 4)}
    assert got == want
    for decay in (0.0, 0.25):
        got = {(r.cache_size, r.interval): r.hit_ratio for r in an.heatmap_hit_ratio_size(d, 6, 3, 100, decay).collect()}
        for size in (0, 3, 6):
            h, m = hits(0, 400, size), None
            for i in range(4):
                own = sum(h[i * 100 : i * 100 + 100]) / 100
                m = own if m is None else m * decay + (1 - decay) * own
                assert abs(got[size, i] - m) < 1e-6


def test_trimmed(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([100, 1, 2, 6, 50])], "win bigint, n bigint")
    assert tuple(an.trimmed(rows, "n", "win", 1, 1).first()) == (5, 3, 3.0, 2.160247, 6.0)
    assert tuple(an.trimmed(rows, "n", "win", 3, 3).first()) == (5, 0, 0.0, 0.0, 6.0)
    assert tuple(an.trimmed(rows.filter("false"), "n", "win", 1, 1).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_median_of_even_numbers(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([9, 1, 4, 4, 20, 3])], "win bigint, n bigint")
    assert an.trimmed(rows, "n", "win", 0, 0).first()["median"] == 4.0
    assert an.trimmed(rows.filter("win in (1, 2)"), "n", "win", 0, 0).first()["median"] == 2.5
