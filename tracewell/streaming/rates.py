"""The windowed analyses, and an online cache, on a stream of requests (columns ts, obj_id, obj_size)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_rates(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, bytes and (approximately) objects per tumbling window of event time; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return w.agg(F.count("*").alias("n_req"), F.sum("obj_size").alias("bytes"), F.approx_count_distinct("obj_id").alias("n_obj")).select(F.col("w.start").alias("start"), "n_req", "bytes", "n_obj")


def reuse_times(stream: DataFrame) -> DataFrame:
    """Each request with the time since its object's previous one (null for a first), kept as state per object."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values("ts")
            times = (f["ts"] - pd.Timestamp(0)).dt.total_seconds().astype("int64")
            since = times.diff().astype("Int64")
            if last is not None and len(since):
                since.iloc[0] = int(times.iloc[0]) - last
            last = int(times.iloc[-1])
            yield pd.DataFrame({"obj_id": key[0], "ts": f["ts"].to_numpy(), "since_last": since.to_numpy(dtype=object, na_value=None)})
        state.update((last,))

    return stream.select("obj_id", "ts").groupBy("obj_id").applyInPandasWithState(step, "obj_id bigint, ts timestamp, since_last bigint", "last bigint", "append", "NoTimeout")
