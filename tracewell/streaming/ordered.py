"""Requests of a stream that come late, brought into the order of each object's times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(stream: DataFrame, late: str = "300 seconds", idle_seconds: int = 86400) -> DataFrame:
    """obj_id, ts, obj_size, since_last (seconds; null for a first request): each object's requests in the order of their times.

    A request is held back until the watermark has passed it, so requests up to `late` behind the stream's latest come out in
    their place, equal times by size. Those behind the watermark of the batch before are left out; what that batch let out is never later
    than its watermark, so nothing comes out behind a later request. An object's state is its last time and the requests
    held back, which the watermark bounds; it goes when the object was idle for so long after its last request, and a
    request after that counts as a first. A timer per object lets requests out even if no other of the object comes. Rows without an
    object or time are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, times, sizes = state.get if state.exists else (None, [], [])
        held = list(zip(times, sizes))
        for f in frames:
            held += zip(f["us"].tolist(), f["size"].tolist())
        held.sort()
        passed = state.getCurrentWatermarkMs()
        out = [x for x in held if x[0] <= passed * 1000]
        rest = held[len(out) :]
        if out:
            before = [last, *(t for t, _ in out[:-1])]
            last = out[-1][0]
            since = [None if b is None else (t - b) / 1e6 for b, (t, _) in zip(before, out)]
            yield pd.DataFrame({"obj_id": key[0], "us": [t for t, _ in out], "obj_size": [s for _, s in out], "since_last": pd.array(since, "Float64")})
        wake = rest[0][0] // 1000 + 1 if rest else last // 1000 + idle_seconds * 1000
        if wake <= passed:
            state.remove()
            return
        state.update((last, [t for t, _ in rest], [s for _, s in rest]))
        state.setTimeoutTimestamp(wake)

    # A missing size is told by -1 while it is held.
    rows = stream.filter("obj_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("obj_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("obj_size", F.lit(-1)).cast("bigint").alias("size"))
    out = rows.groupBy("obj_id").applyInPandasWithState(step, "obj_id bigint, us bigint, obj_size bigint, since_last double", "last bigint, times array<bigint>, sizes array<bigint>", "append", "EventTimeTimeout")
    return out.select("obj_id", F.timestamp_micros("us").alias("ts"), F.when(F.col("obj_size") >= 0, F.col("obj_size")).alias("obj_size"), "since_last")
