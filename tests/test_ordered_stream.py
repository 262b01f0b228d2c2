"""Late requests against sorting everything."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.streaming.ordered import in_order

SCHEMA = "obj_id bigint, at bigint, obj_size bigint, times string"


def run(spark, batches, folder, name, **how):
    """Each batch is a file; they are read one by one, in order."""
    schema = None
    for k, rows in enumerate(batches):
        b = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        b.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        schema = b.schema
    # Written in order, so the files' times are in order too.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    q = in_order(stream, **how).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    left = [p["numRowsTotal"] for p in q.lastProgress["stateOperators"]] if isinstance(q.lastProgress, dict) else [p.numRowsTotal for p in q.lastProgress.stateOperators]
    q.stop()
    return [(r["obj_id"], int(r["ts"].timestamp()), r["obj_size"], r["since_last"]) for r in spark.table(name).collect()], left


def test_late_requests_come_out_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    # Times rise by up to 20 s a request, and each is told up to 250 s late; one object has a third of all requests.
    times = np.cumsum(rng.integers(0, 20, 300)) + 10**6
    rows = [(int(1 if rng.random() < 0.33 else rng.integers(2, 20)), int(t), int(rng.integers(1, 50)) if k % 11 else None, "x") for k, t in enumerate(times)]
    told = sorted(range(len(rows)), key=lambda k: times[k] + rng.integers(0, 250))
    batches = [[rows[k] for k in told[i : i + 50]] for i in range(0, len(told), 50)]
    batches[2] += [(None, 10**6, 1, "x"), (5, None, 1, "x")]
    end = int(times[-1]) + 5000
    got, left = run(spark, [*batches, [(99, end, 1, "x")], [(99, end + 1, 1, "x")]], tmp_path, "late")
    want, last = [], {}
    for o, t, s, _ in sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2])):
        want.append((o, t, s, float(t - last[o]) if o in last else None))
        last[o] = t
    for o in last:
        assert [r for r in got if r[0] == o] == [r for r in want if r[0] == o]
    assert len(got) == len(want) and left[0] == len(last) + 1


def test_idle_objects_and_rows_that_are_too_late(spark, tmp_path):
    batches = [[(1, 1000, 5, "x")], [(2, 9000, 5, "x")], [(2, 9005, 5, "x")], [(1, 1500, 5, "x"), (2, 9010, 6, "x")], [(1, 9020, 7, "x")], [(3, 20000, 1, "x")], [(3, 30000, 1, "x")]]
    got, left = run(spark, batches, tmp_path, "idle", late="100 seconds", idle_seconds=3600)
    # 1500 is behind the watermark of the batch before; object 1 was forgotten by 9020; objects 1 and 2 are gone in the end.
    assert sorted(got, key=repr) == sorted([(1, 1000, 5, None), (2, 9000, 5, None), (2, 9005, 5, 5.0), (2, 9010, 6, 5.0), (1, 9020, 7, None), (3, 20000, 1, None)], key=repr)
    assert left == [1]
