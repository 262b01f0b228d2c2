"""Stack distances in weights instead of objects, and the miss ratios of LRU caches that hold bytes.

A request's weighted distance is the sum of the weights of the other objects since its object's previous access. It is
counted as in `distance`: over requests j before i with p(j) <= p(i) weights are summed, by blocks of place and of
previous place, and the running sum of all weights up to p(i) is taken off. Several weights go through one pass, and
objects that a cache is too small for have weight 0 for that cache.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .distance import block_length
from .prep import oracle_annotate, with_neighbours


def sums_before(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each value of an array the summed weights (a row for each kind) of smaller ones before it. Doubling runs are merged by sorting. Values differ."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    out, width, place = np.zeros(weights.shape, np.int64), 1, np.arange(n)
    while width < n:
        right = (place // width) % 2 == 1
        order = np.lexsort((rank, place // (2 * width)))
        group = (place // (2 * width))[order]
        left = np.where(right[order], 0, weights[:, order])
        before = np.cumsum(left, axis=1) - left
        start = np.searchsorted(group, group)
        out[:, order] += np.where(right[order], before - before[:, start], 0)
        width *= 2
    return out


def _running(rows: DataFrame, names: list[str], block: int, label: str) -> DataFrame:
    """rows with a sum of each name over all rows up to its own place (vtime): sums within blocks, then over the blocks."""
    b = rows.withColumn("b", F.floor(F.col("vtime") / block))
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a block.
    blocks = b.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).select("b", *[(F.sum(n).over(up) - F.col(n)).alias(f"{n}_base") for n in names])
    inside = Window.partitionBy("b").orderBy("vtime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumns({f"{n}_{label}": F.sum(n).over(inside) for n in names}).join(blocks, "b").select(*rows.columns, *[(F.col(f"{n}_base") + F.col(f"{n}_{label}")).alias(f"{n}_{label}") for n in names])


def weighted_distances(trace: DataFrame, weights: dict[str, Column], keep: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """vtime, obj_id, the columns to keep, prev_vtime, next_vtime, and for each weight (its name) the sum over other objects since the previous access, null for a first access. An object's weight is the same in all its requests and not negative."""
    names = list(weights)
    n = with_neighbours(trace.select("vtime", "obj_id", *keep, *[w.cast("long").alias(c) for c, w in weights.items()]))
    d = stored(n.select("vtime", "obj_id", *keep, F.col("prev.vtime").alias("prev_vtime"), F.col("next.vtime").alias("next_vtime"), *names), "weighted")
    last = d.agg(F.max("vtime")).first()[0] or 0
    block = block or block_length(last)
    warm = d.filter("prev_vtime is not null").select("vtime", F.col("prev_vtime").alias("p"), F.floor(F.col("vtime") / block).alias("b"), F.floor(F.col("prev_vtime") / block).alias("c"), *names)

    def framed(pdf: pd.DataFrame, sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"vtime": pdf["vtime"].to_numpy()} | {c: sums[k] for k, c in enumerate(names)})

    def within_place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vtime")
        return framed(pdf, sums_before(pdf["p"].to_numpy(), pdf[names].to_numpy(np.int64).T))

    def within_prev(pdf: pd.DataFrame) -> pd.DataFrame:
        # Earlier blocks of places only: for equal blocks within_place has counted.
        pdf = pdf.sort_values(["b", "p"])
        b, w = pdf["b"].to_numpy(), pdf[names].to_numpy(np.int64).T
        before = np.cumsum(w, axis=1) - w
        return framed(pdf, sums_before(pdf["p"].to_numpy(), w) - (before - before[:, np.searchsorted(b, b)]))

    schema = "vtime bigint, " + ", ".join(f"{c} bigint" for c in names)
    near = warm.groupBy("b").applyInPandas(within_place, schema)
    far = warm.groupBy("c").applyInPandas(within_prev, schema)
    # Block pairs: requests of earlier place blocks whose p lies in an earlier p block. One row per pair of blocks.
    cells = warm.groupBy("b", "c").agg(*[F.sum(n).alias(n) for n in names])
    k = last // block + 1
    places = trace.sparkSession.range(k * k).select(F.expr(f"id div {k}").alias("b"), (F.col("id") % k).alias("c")).filter("c <= b")
    grid = places.join(cells, ["b", "c"], "left").na.fill(0, names)
    up = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    above = grid.withColumns({n: F.coalesce(F.sum(n).over(up), zero) for n in names})
    sums = above.withColumns({n: F.coalesce(F.sum(n).over(left), zero) for n in names})
    pairs = warm.select("vtime", "b", "c").join(sums, ["b", "c"]).select("vtime", *names)
    # First accesses (p = 0) before the request, less everything up to its previous access: two running sums.
    firsts = {f"{n}_f": F.when(F.col("prev_vtime").isNull(), F.col(n)).otherwise(0) for n in names}
    run = _running(d.select("vtime", "prev_vtime", "next_vtime", *names, *[c.alias(n) for n, c in firsts.items()]), [*names, *firsts], block, "sum")
    seen = run.filter("prev_vtime is not null").select("vtime", *[F.col(f"{n}_f_sum").alias(n) for n in names])
    passed = run.filter("next_vtime is not null").select(F.col("next_vtime").alias("vtime"), *[(-F.col(f"{n}_sum")).alias(n) for n in names])
    total = near.unionByName(far).unionByName(pairs).unionByName(seen).unionByName(passed).groupBy("vtime").agg(*[F.sum(n).alias(n) for n in names])
    return d.drop(*names).join(total, "vtime", "left")


def byte_distances(trace: DataFrame, sizes: list[int], overhead: int = 0) -> DataFrame:
    """vtime, obj_id, obj_size (the object's first), room (with the overhead that a cache keeps for it), prev_vtime, next_vtime, and b_0, b_1, ...: the room of other objects since the previous access, of those that fit into a cache of sizes[0], sizes[1], ... bytes."""
    sized = oracle_annotate(trace).select("vtime", "obj_id", "obj_size", (F.col("obj_size") + overhead).alias("room"))
    return weighted_distances(sized, {f"b_{k}": F.when(F.col("room") <= c, F.col("room")).otherwise(0) for k, c in enumerate(sizes)}, ("obj_size", "room"))


def byte_hit(k: int, size: int) -> Column:
    """Whether an LRU cache of sizes[k] bytes holds the object: it and all objects since fit in. An object larger than the cache never comes in."""
    return F.coalesce((F.col("room") <= size) & (F.col(f"b_{k}") + F.col("room") <= size), F.lit(False))


def byte_misses(distances: DataFrame, sizes: list[int]) -> DataFrame:
    """cache_size (bytes), n_req, n_miss, miss_ratio, byte_miss_ratio of an LRU cache of each size, from one table of byte_distances."""
    sums = [F.sum(F.when(byte_hit(k, c), 0).otherwise(x)).alias(f"{n}_{k}") for k, c in enumerate(sizes) for n, x in (("n", F.lit(1)), ("m", F.col("obj_size")))]
    one = distances.agg(F.count("*").alias("n_req"), F.sum("obj_size").alias("bytes"), *sums)
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("cache_size"), F.col(f"n_{k}").alias("n"), F.col(f"m_{k}").alias("m")) for k, c in enumerate(sizes)])
    each = one.filter("n_req > 0").select("n_req", "bytes", F.explode(rows).alias("r"))
    return each.select("r.cache_size", "n_req", F.col("r.n").alias("n_miss"), F.round(F.col("r.n") / F.col("n_req"), 6).alias("miss_ratio"), F.round(F.col("r.m") / F.col("bytes"), 6).alias("byte_miss_ratio"))
