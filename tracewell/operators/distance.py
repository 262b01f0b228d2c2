"""Access and stack distances, and the exact LRU miss-ratio curve.

The stack distance of request i with previous access p(i) is the number of requests j < i with p(j) <= p(i), less p(i)
(p = 0 for a first access). This is counted without putting the trace into one task: requests are cut into blocks by their
own place and by p's. Pairs of blocks are summed from a small table of block counts; what is left are pairs within a
block of places, and within a block of p, and each block is one group. Blocks grow with the square root of the trace, so
that the table of all pairs of blocks has at most a quarter row a request (and some more in small traces).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .prep import with_neighbours

BLOCK = 1 << 16


def block_length(n: int) -> int:
    """A power of two, from BLOCK up, of which (n / length)^2 / 2, the pairs of blocks, is at most n / 4."""
    length = BLOCK
    while length * length < 2 * n:
        length *= 2
    return length


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value of an array the number of smaller or equal ones before it. Doubling runs are merged by sorting."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    out, width = np.zeros(n, np.int64), 1
    place = np.arange(n)
    while width < n:
        right = (place // width) % 2 == 1
        order = np.lexsort((rank, place // (2 * width)))
        left_before = np.cumsum(~right[order])
        group = (place // (2 * width))[order]
        start = np.searchsorted(group, group)
        base = left_before[start] - ~right[order][start]
        out[order] += np.where(right[order], left_before - base, 0)
        width *= 2
    return out


def access_distances(trace: DataFrame) -> DataFrame:
    """vtime, obj_id, dist_last, dist_first (-1: first access), prev_vtime, next_vtime."""
    n = with_neighbours(trace.select("vtime", "obj_id"))
    none = F.lit(-1).cast("long")
    prev = F.col("prev.vtime")
    return n.select("vtime", "obj_id", F.coalesce(F.col("vtime") - prev, none).alias("dist_last"), F.when(prev.isNull(), none).otherwise(F.col("vtime") - F.col("first.vtime")).alias("dist_first"), prev.alias("prev_vtime"), F.col("next.vtime").alias("next_vtime"))


def stack_distances(trace: DataFrame, block: int | None = None) -> DataFrame:
    """vtime, obj_id, prev_vtime, next_vtime, stack_dist: the number of other objects since the previous access, -1 for a first access. Without a block, its length follows from the trace's."""
    d = stored(access_distances(trace).select("vtime", "obj_id", "prev_vtime", "next_vtime"), "accesses")
    last = d.agg(F.max("vtime")).first()[0] or 0
    block = block or block_length(last)
    warm = d.filter("prev_vtime is not null").select("vtime", F.col("prev_vtime").alias("p"), F.floor(F.col("vtime") / block).alias("b"), F.floor(F.col("prev_vtime") / block).alias("c"))

    def within_place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vtime")
        return pd.DataFrame({"vtime": pdf["vtime"], "n": smaller_before(pdf["p"].to_numpy())})

    def within_prev(pdf: pd.DataFrame) -> pd.DataFrame:
        # Earlier blocks of places only: for equal blocks within_place has counted.
        pdf = pdf.sort_values(["b", "p"])
        b, p = pdf["b"].to_numpy(), pdf["p"].to_numpy()
        all_before, own = smaller_before(p), np.arange(len(p)) - np.searchsorted(b, b)
        return pd.DataFrame({"vtime": pdf["vtime"], "n": all_before - own})

    near = warm.groupBy("b").applyInPandas(within_place, "vtime bigint, n bigint")
    far = warm.groupBy("c").applyInPandas(within_prev, "vtime bigint, n bigint")
    # Block pairs: requests of earlier place blocks whose p lies in an earlier p block. One row per pair of blocks.
    cells = warm.groupBy("b", "c").agg(F.count("*").alias("n"))
    k = last // block + 1
    places = trace.sparkSession.range(k * k).select(F.expr(f"id div {k}").alias("b"), (F.col("id") % k).alias("c")).filter("c <= b")
    grid = places.join(cells, ["b", "c"], "left").na.fill(0, ["n"])
    up = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    sums = grid.withColumn("above", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("n", F.coalesce(F.sum("above").over(left), F.lit(0))).select("b", "c", "n")
    pairs = warm.join(sums, ["b", "c"]).select("vtime", "n")
    # First accesses (p = 0) before the request: running sums within blocks, then over blocks.
    first = d.withColumn("b", F.floor(F.col("vtime") / block)).withColumn("one", F.col("prev_vtime").isNull().cast("long"))
    blocks = first.groupBy("b").agg(F.sum("one").alias("ones"))
    blocks = blocks.select("b", (F.sum("ones").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ones")).alias("base"))
    seen = first.withColumn("seen", F.sum("one").over(Window.partitionBy("b").orderBy("vtime").rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(blocks, "b")
    firsts = seen.filter("one = 0").select("vtime", (F.col("base") + F.col("seen")).alias("n"))
    total = near.unionByName(far).unionByName(pairs).unionByName(firsts).groupBy("vtime").agg(F.sum("n").alias("n"))
    out = d.join(total, "vtime", "left")
    return out.select("vtime", "obj_id", "prev_vtime", "next_vtime", F.when(F.col("prev_vtime").isNull(), F.lit(-1).cast("long")).otherwise(F.col("n") - F.col("prev_vtime")).alias("stack_dist"))


def future_stack_distances(trace: DataFrame) -> DataFrame:
    """vtime, future_stack_dist: the stack distance of the object's next access, -1 if there is none."""
    d = stored(stack_distances(trace), "stack-distances")
    came = d.filter("prev_vtime is not null").select(F.col("prev_vtime").alias("vtime"), F.col("stack_dist").alias("future_stack_dist"))
    return d.select("vtime").join(came, "vtime", "left").select("vtime", F.coalesce("future_stack_dist", F.lit(-1).cast("long")).alias("future_stack_dist"))


def lru_curve(trace: DataFrame, max_size: int | None = None) -> DataFrame:
    """cache_size (objects), miss_ratio: exact, for each size from 0 to the number of objects (or max_size)."""
    hist = stored(stack_distances(trace).groupBy("stack_dist").agg(F.count("*").alias("n")), "stack-histogram")
    total = hist.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("stack_dist") < 0, F.col("n")).otherwise(0)).alias("cold"))
    sums = total.first()
    top = max_size if max_size is not None else sums["cold"]
    # One row a size, made by all tasks.
    spine = trace.sparkSession.range((top or 0) + 1 if sums["total"] else 0).select(F.lit(sums["total"]).alias("total"), F.col("id").alias("cache_size"))
    hits = hist.filter("stack_dist >= 0").select((F.col("stack_dist") + 1).alias("cache_size"), "n")
    # The curve has as many rows as there are objects: sums within pieces of sizes, then over the pieces.
    rows = spine.join(hits, "cache_size", "left").na.fill(0, ["n"]).withColumn("piece", F.floor(F.col("cache_size") / BLOCK))
    pieces = rows.groupBy("piece").agg(F.sum("n").alias("all"))
    up = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.select("piece", (F.sum("all").over(up) - F.col("all")).alias("base"))
    inside = Window.partitionBy("piece").orderBy("cache_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(pieces, "piece").select("cache_size", F.round(1 - (F.col("base") + F.sum("n").over(inside)) / F.col("total"), 6).alias("miss_ratio"))


