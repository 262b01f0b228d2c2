"""Caches behind one another, and caches side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .distance import lru_curve
from .lru import dense, sharded_miss_trace

RING = 1 << 32


def point(key: Column) -> Column:
    """A place on the ring from the MD5 of a text."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def ring(servers: DataFrame, points: int = 160) -> DataFrame:
    """low, high, server: the arcs that each server (column server) owns, from 160 points each. One row per point."""
    each = servers.select("server", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select("server", point(F.concat_ws("-", F.col("server").cast("string"), F.col("k").cast("string"))).alias("at"))
    each = each.groupBy("at").agg(F.min("server").alias("server"))
    by_place = Window.orderBy("at")
    arcs = each.select(F.coalesce(F.lag("at").over(by_place) + 1, F.lit(0)).alias("low"), F.col("at").alias("high"), "server", F.lead("at").over(by_place).isNull().alias("last"))
    first = each.agg(F.min_by("server", "at").alias("first"))
    # What lies beyond the last point belongs to the first.
    tail = arcs.filter("last").select((F.col("high") + 1).alias("low"), F.lit(RING - 1).cast("long").alias("high")).withColumn("server", first.scalar())
    return arcs.drop("last").unionByName(tail)


def routed(trace: DataFrame, servers: DataFrame) -> DataFrame:
    """Each request with its server. Objects are looked up once each; arcs and points meet in cells of the ring, by an equi-join."""
    cells = 1 << 12
    width = RING // cells
    arcs = ring(servers).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    objects = trace.select("obj_id").distinct().withColumn("at", point(F.col("obj_id").cast("string"))).withColumn("cell", F.floor(F.col("at") / width))
    where = objects.join(arcs, "cell").filter("at >= low and at <= high").select("obj_id", "server")
    return trace.join(where, "obj_id")


def merged(*traces: DataFrame) -> DataFrame:
    """Traces merged in order of time (ties by trace, then by their own order), without vtime: see with_vtime."""
    out = None
    for k, t in enumerate(traces):
        rows = t.withColumn("trace_no", F.lit(k)).withColumnRenamed("vtime", "own_vtime")
        out = rows if out is None else out.unionByName(rows)
    return out


def hierarchy(trace: DataFrame, l1_size: int, l1_count: int) -> DataFrame:
    """The LRU curve of a second cache behind l1_count first ones of l1_size objects each, which share the objects. The misses, in their old order, are the second trace."""
    misses = stored(sharded_miss_trace(trace, l1_size, l1_count), "misses")
    return lru_curve(stored(dense(misses, "own_vtime").select("vtime", "obj_id"), "second-trace"))


def replicas(trace: DataFrame, servers: DataFrame, n: int, points: int = 160) -> DataFrame:
    """Each object with its first n servers: those that own the arcs from its place onwards, each server once. Servers are few next to objects; their points are laid out once for each arc."""
    arcs = ring(servers, points).select("low", "high", "server")
    by_place = Window.orderBy("low")
    numbered = arcs.withColumn("k", F.row_number().over(by_place))
    m = numbered.count()
    # The arcs that follow each one, as far as n different servers may need; short of that, all of them.
    reach = min(m, points * n + n)
    after = numbered.select("k", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("step")).withColumn("other", (F.col("k") - 1 + F.col("step")) % m + 1)
    seen = after.join(numbered.select(F.col("k").alias("other"), "server"), "other").groupBy("k", "low", "high", "server").agg(F.min("step").alias("step"))
    ranked = seen.withColumn("replica", F.row_number().over(Window.partitionBy("k").orderBy("step"))).filter(F.col("replica") <= n)
    cells = 1 << 12
    width = RING // cells
    arcs_of = ranked.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    objects = trace.select("obj_id").distinct().withColumn("at", point(F.col("obj_id").cast("string"))).withColumn("cell", F.floor(F.col("at") / width))
    return objects.join(arcs_of, "cell").filter("at >= low and at <= high").select("obj_id", "replica", "server")


def server_load(trace: DataFrame, servers: DataFrame) -> DataFrame:
    """Per server: requests, bytes and objects."""
    return routed(trace, servers).groupBy("server").agg(F.count("*").alias("n_req"), F.sum("obj_size").alias("bytes"), F.countDistinct("obj_id").alias("n_obj"))
