"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From links (a, b), in either direction, to (id, component): the smallest id that is reachable. Ids without links are left out.

    Alternates two steps until no link changes: every larger neighbour of a node is hung on the node's smallest
    neighbour, then every smaller one is. Links fall into stars around the smallest ids. Each round's table is written.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        # One row a node in a table of its own, so that the join's rows of a hub can be split at run time.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "links-large")
        # After this step each link points to a smaller id; a node's smaller neighbours meet at the smallest of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "links-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        before, edges = edges, written(small, "links")
        discard(before, least, large, low)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    else:
        raise RuntimeError("the links did not settle")
    # Stars only now: every id but the smallest of its component has one link, to that smallest.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links (a, b): only components and the links between them are looked at again."""
    lifted = with_smallest(with_smallest(links.withColumnRenamed("a", "id"), comps).select(F.col("component").alias("a"), F.col("b").alias("id")), comps).select("a", F.col("component").alias("b")).filter("a <> b")
    merged = components(lifted)
    moved = comps.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # What merged has are components' smallest ids, and ids without links so far: comps has none of them as an id.
    return written(moved.unionByName(merged), "links-joined")


def with_smallest(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds `component` to a table with `id`: from comps, or the id itself."""
    return ids.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
