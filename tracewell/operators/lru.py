"""What LRU caches do, from stack distances: a cache of c objects hits a request if its object came before and fewer than c other objects came since. Nothing is replayed; all sizes come from one table of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..sources.tables import with_vtime
from .distance import stack_distances
from .prep import oracle_annotate, with_neighbours


def dense(rows: DataFrame, *order: str) -> DataFrame:
    """The rows numbered anew (vtime) in an order; the old number is own_vtime."""
    return with_vtime(rows.withColumnRenamed("vtime", "own_vtime"), *order)


def missed(size: Column | int) -> Column:
    return (F.col("stack_dist") < 0) | (F.col("stack_dist") >= size)


def distances_with_sizes(trace: DataFrame) -> DataFrame:
    """vtime, obj_id, stack_dist, obj_size (the object's first size)."""
    sizes = oracle_annotate(trace).select("vtime", "obj_size")
    return stack_distances(trace).select("vtime", "obj_id", "stack_dist").join(sizes, "vtime")


def lru_misses(distances: DataFrame, sizes: list[int]) -> DataFrame:
    """cache_size, n_req, n_miss, miss_ratio, byte_miss_ratio from one pass over vtime, stack_dist, obj_size. A null distance always misses."""
    miss = lambda c: F.coalesce(missed(c), F.lit(True))
    sums = [F.sum(F.when(miss(c), x).otherwise(0)).alias(f"{n}_{c}") for c in sizes for n, x in (("n", F.lit(1)), ("b", F.col("obj_size")))]
    one = distances.agg(F.count("*").alias("n_req"), F.sum("obj_size").alias("bytes"), *sums)
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("cache_size"), F.col(f"n_{c}").alias("n_miss"), F.col(f"b_{c}").alias("b_miss")) for c in sizes])
    each = one.select("n_req", "bytes", F.explode(rows).alias("r"))
    return each.select(F.lit("lru").alias("policy"), "r.cache_size", "n_req", "r.n_miss", F.round(F.col("r.n_miss") / F.col("n_req"), 6).alias("miss_ratio"), F.round(F.col("r.b_miss") / F.col("bytes"), 6).alias("byte_miss_ratio"))


def admitted_distances(trace: DataFrame, condition: str) -> DataFrame:
    """As distances_with_sizes where only objects that meet a condition on obj_size (their first size) come into the cache; the others have no distance."""
    sized = stored(oracle_annotate(trace).select("vtime", "obj_id", "obj_size"), "sized")
    inside = stored(dense(sized.filter(condition).select("vtime", "obj_id"), "own_vtime"), "admitted")
    found = stack_distances(inside.select("vtime", "obj_id")).select("vtime", "stack_dist").join(inside.select("vtime", "own_vtime"), "vtime").select(F.col("own_vtime").alias("vtime"), "stack_dist")
    return sized.join(found, "vtime", "left")


def second_sightings(trace: DataFrame) -> DataFrame:
    """As distances_with_sizes where an object comes into the cache from its second request on: the first one leaves the cache as it was."""
    sized = stored(oracle_annotate(trace).select("vtime", "obj_id", "obj_size"), "sized")
    again = stored(dense(with_neighbours(sized.select("vtime", "obj_id")).filter("prev is not null").select("vtime", "obj_id"), "own_vtime"), "seen-again")
    found = stack_distances(again.select("vtime", "obj_id")).join(again.select("vtime", "own_vtime"), "vtime").select(F.col("own_vtime").alias("vtime"), "stack_dist")
    return sized.join(found, "vtime", "left")


def after_warmup(rows: DataFrame, n_req: int = 0, seconds: int = 0) -> DataFrame:
    """The rows (with vtime, and t if seconds count) that statistics take: those after the first n_req requests and the first seconds. The others have changed the cache by then, as distances go back to them."""
    late = F.col("vtime") > n_req
    return rows.filter(late & (F.col("t") >= seconds) if seconds else late)


def interval_report(distances: DataFrame, size: int, interval: int) -> DataFrame:
    """Miss ratios of one cache per interval of requests, and since the start."""
    per = distances.groupBy(F.floor((F.col("vtime") - 1) / interval).alias("interval")).agg(F.count("*").alias("n_req"), F.count(F.when(missed(size), 1)).alias("n_miss"))
    up = Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("interval", F.round(F.col("n_miss") / F.col("n_req"), 6).alias("miss_ratio"), F.round(F.sum("n_miss").over(up) / F.sum("n_req").over(up), 6).alias("miss_ratio_so_far"))


def miss_trace(trace: DataFrame, size: int) -> DataFrame:
    """The requests that a cache passes on: vtime, obj_id."""
    return stack_distances(trace).filter(missed(size)).select("vtime", "obj_id")


def sharded_miss_trace(trace: DataFrame, size: int, shards: int) -> DataFrame:
    """The requests that caches side by side pass on, each with its share of the objects (by id). Shards are laid out one after another: as they share no object, distances within the whole are those within each."""
    placed = trace.select("vtime", "obj_id", F.pmod("obj_id", F.lit(shards)).alias("shard"))
    placed = stored(dense(placed, "shard", "own_vtime"), "shards")
    misses = stack_distances(placed.select("vtime", "obj_id")).filter(missed(size)).select("vtime")
    return placed.join(misses, "vtime").select(F.col("own_vtime").alias("vtime"), "obj_id")
