"""Working set and LRU curve of a long trace from a part of its objects, with standard errors.

Every request of an object is in the sample or none is; an object is in it by a hash of its id, with a chance of 1 in `one_in`. A sum over
objects is estimated by `one_in` times the sample's, and its variance by one_in * (one_in - 1) times the sample's sum of squares.

Defined cases: an empty trace or sample gives a working set of 0 and a curve without rows; null ids are never in the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .distance import stack_distances
from .lru import dense
from .prep import scalar


def object_sample(trace: DataFrame, one_in: int) -> DataFrame:
    """All requests of the objects whose MD5 falls into the sample."""
    number = F.conv(F.substring(F.md5(F.col("obj_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return trace.filter(number % one_in == 0)


def _total(x: Column, one_in: int) -> Column:
    return F.coalesce(one_in * F.sum(x), F.lit(0))


def _error(x: Column, one_in: int) -> Column:
    return F.sqrt(F.lit(float(one_in * (one_in - 1))) * F.coalesce(F.sum(x.cast("double") * x), F.lit(0.0)))


def sampled_working_set(trace: DataFrame, one_in: int) -> DataFrame:
    """One row: objects and bytes (each object with its first size), estimated, with their standard errors."""
    objects = object_sample(trace, one_in).groupBy("obj_id").agg(F.min_by("obj_size", "vtime").alias("size")).withColumn("one", F.lit(1).cast("bigint"))
    return objects.agg(
        _total(F.col("one"), one_in).alias("wss_obj"), F.round(_error(F.col("one"), one_in), 6).alias("wss_obj_error"),
        _total(F.col("size"), one_in).alias("wss_byte"), F.round(_error(F.col("size"), one_in), 6).alias("wss_byte_error"),
    )


def sampled_curve(trace: DataFrame, sizes: list[int], one_in: int) -> DataFrame:
    """cache_size, miss_ratio, std_error of LRU caches. A stack distance in the sample stands for one_in times as many objects, so a cache of c objects is one of c / one_in in the sample.

    Distances are counted over the sample only, a one_in-th of the objects. Misses are estimated, not hits: those of an object with a third of all
    requests are few, so it matters little whether it is in the sample. The error is that of the choice of objects; rescaled distances add
    a bias in caches of few times one_in objects.
    """
    kept = stored(dense(object_sample(trace.select("vtime", "obj_id"), one_in), "own_vtime").select("vtime", "obj_id"), "sample")
    miss = lambda c: (F.col("stack_dist") < 0) | (F.col("stack_dist") * one_in >= c)
    each = stack_distances(kept).groupBy("obj_id").agg(*[F.count_if(miss(c)).alias(f"m_{c}") for c in sizes])
    rows = each.select(F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("cache_size"), F.col(f"m_{c}").alias("n")) for c in sizes])).alias("r")).select("r.*")
    all_ = scalar(trace, F.count("*"))
    return rows.groupBy("cache_size").agg(_total(F.col("n"), one_in).alias("n"), _error(F.col("n"), one_in).alias("e")).select("cache_size", F.round(F.col("n") / all_, 6).alias("miss_ratio"), F.round(F.col("e") / all_, 6).alias("std_error"))
