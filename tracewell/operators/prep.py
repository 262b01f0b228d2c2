"""Next and previous accesses, sizes, samples: what the analyses start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import WRITES

#: An object's accesses are sorted in slices of so many requests, so that an object with a third of all requests is not one sort.
SLICE = 1 << 20


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate of a table as a scalar subquery."""
    return df.select(value).scalar()


def with_neighbours(trace: DataFrame, *fields: str, slice_len: int = SLICE) -> DataFrame:
    """Adds prev, next and first: structs of vtime and the fields at the object's previous, next and first access (null if there is none).

    Rows are linked within (object, slice); the ends of slices are linked in a table of one row per object and slice.
    """
    what = F.struct("vtime", *fields)
    rows = trace.withColumn("slice", F.floor(F.col("vtime") / slice_len)).withColumn("own", what)
    inside = Window.partitionBy("obj_id", "slice").orderBy("vtime")
    ends = rows.groupBy("obj_id", "slice").agg(F.min("own").alias("head"), F.max("own").alias("tail"))
    over = Window.partitionBy("obj_id").orderBy("slice")
    ends = ends.select("obj_id", "slice", F.lag("tail").over(over).alias("before"), F.lead("head").over(over).alias("after"), F.first("head").over(over).alias("first"))
    linked = rows.withColumn("p", F.lag("own").over(inside)).withColumn("n", F.lead("own").over(inside))
    joined = linked.join(ends, ["obj_id", "slice"])
    return joined.select(*trace.columns, F.coalesce("p", "before").alias("prev"), F.coalesce("n", "after").alias("next"), "first")


def timed(trace: DataFrame) -> DataFrame:
    """The trace with t, seconds from the first request: enough for analyses that don't look at other accesses."""
    return trace.withColumn("t", F.col("clock_time") - scalar(trace, F.min("clock_time")))


def annotate(trace: DataFrame, window: int = 3600) -> DataFrame:
    """Each request with what its object's history says about it."""
    t = timed(trace)
    n = with_neighbours(t, "t", "obj_size")
    cold = F.col("prev").isNull()
    none = F.lit(-1).cast("long")
    return n.select(
        *t.columns, cold.alias("compulsory_miss"),
        F.coalesce(F.col("vtime") - F.col("prev.vtime"), none).alias("vtime_since_last"), F.coalesce(F.col("t") - F.col("prev.t"), none).alias("rtime_since_last"),
        F.col("first.t").alias("create_rtime"), F.coalesce("prev.obj_size", none).alias("prev_size"), (~cold & F.col("op").isin(WRITES)).alias("overwrite"),
        (cold | (F.floor(F.col("prev.t") / window) != F.floor(F.col("t") / window))).alias("first_seen_in_window"),
        F.col("next.vtime").alias("next_vtime"), F.col("next.t").alias("next_t"), F.col("first.vtime").alias("first_vtime"),
    )


def oracle_annotate(trace: DataFrame, remove_size_change: bool = True) -> DataFrame:
    """Adds next_access_vtime (-1: never again); sizes become the object's first one if asked for."""
    n = with_neighbours(trace, "obj_size")
    size = F.col("first.obj_size") if remove_size_change else F.col("obj_size")
    return n.withColumn("obj_size", size).withColumn("next_access_vtime", F.coalesce("next.vtime", F.lit(-1).cast("long"))).drop("prev", "next", "first")


def write_aware_next(trace: DataFrame) -> DataFrame:
    """vtime, obj_id, next_access_vtime: as oracle_annotate, but an object's life ends when the next access writes or deletes it."""
    n = with_neighbours(trace, "op")
    ended = F.col("next.op").isin([*WRITES, "delete"])
    return n.select("vtime", "obj_id", F.when(ended | F.col("next").isNull(), F.lit(-1).cast("long")).otherwise(F.col("next.vtime")).alias("next_access_vtime"))


def sample_spatial(trace: DataFrame, one_in: int, hashed: bool = True) -> DataFrame:
    """All requests of one object in so many, by a hash of the id (or by the id itself)."""
    return trace.filter(F.pmod(F.xxhash64("obj_id") if hashed else F.col("obj_id"), F.lit(one_in)) == 0)


def sample_temporal(trace: DataFrame, every: int) -> DataFrame:
    return trace.filter(F.col("vtime") % every == 0)


def working_set(trace: DataFrame) -> DataFrame:
    """n_obj and bytes, each object with its first size; one row."""
    objects = trace.groupBy("obj_id").agg(F.min_by("obj_size", "vtime").alias("size"))
    return objects.agg(F.count("*").alias("wss_obj"), F.sum("size").alias("wss_byte"))
