"""Which objects are asked for together: the probability graph of what follows what, and associations of rare objects by their times.

Both look at a few requests around each one, so the trace is cut into blocks of its order, with the rows after a block's end
repeated in it. A block is one sort of bounded length, whatever an object's share of the requests.

Defined cases: an empty trace gives empty results; an object may follow itself in the graph; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .distance import BLOCK

#: Candidate edges are broadcast up to so many (counted; 24 bytes each), joined beyond.
BROADCAST_ROWS = 200_000


def _overlapping(rows: DataFrame, place: str, reach: int, block: int) -> DataFrame:
    """Rows with `block`, and those within `reach` of a block's start once more for the block before."""
    own = F.floor(F.col(place) / block)
    before = F.floor((F.col(place) - reach) / block)
    return rows.withColumn("block", F.explode(F.sequence(F.greatest(before, F.lit(0)), own)))


def follow_counts(trace: DataFrame, lookahead: int, block: int = BLOCK) -> DataFrame:
    """block, obj_id, next_id, weight: how often next_id is among the next requests of one for obj_id in the block. Requests with fewer than `lookahead` others after them don't count. Counts need no exchange beyond that of the blocks."""
    rows = _overlapping(trace.select("vtime", "obj_id"), "vtime", lookahead, block)
    ahead = F.collect_list("obj_id").over(Window.partitionBy("block").orderBy("vtime").rowsBetween(1, lookahead))
    seen = rows.withColumn("ahead", ahead).filter((F.floor(F.col("vtime") / block) == F.col("block")) & (F.size("ahead") == lookahead))
    return seen.select("block", "obj_id", F.explode("ahead").alias("next_id")).groupBy("block", "obj_id", "next_id").agg(F.count("*").alias("weight"))


def probability_graph(trace: DataFrame, lookahead: int = 20, percent: int = 5, block: int = BLOCK) -> DataFrame:
    """obj_id, next_id, weight, probability (weight by all weights of obj_id): the edges over so many percent.

    An edge that is over the threshold in the whole trace is over it in some block, as weights and totals are sums over the
    blocks. So each block names its candidates, and only their counts leave the blocks: most pairs of a long trace
    are never shuffled. A hot object has one row a block and edge at most.
    """
    cells = follow_counts(trace, lookahead, block)
    over = 100 * F.col("weight") > percent * F.col("total")
    local = cells.withColumn("total", F.sum("weight").over(Window.partitionBy("block", "obj_id")))
    named = stored(local.filter(over).select("obj_id", "next_id").distinct(), "edges")
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    edges = cells.join(F.broadcast(named) if few else named, ["obj_id", "next_id"], "left_semi").groupBy("obj_id", "next_id").agg(F.sum("weight").alias("weight"))
    totals = cells.groupBy("obj_id").agg(F.sum("weight").alias("total"))
    return edges.join(totals, "obj_id").filter(over).select("obj_id", "next_id", "weight", F.round(F.col("weight") / F.col("total"), 6).alias("probability"))


def rare_objects(trace: DataFrame, least: int, most: int, block: int = BLOCK) -> DataFrame:
    """obj_id, times (its requests' vtimes, sorted) of the objects with so many requests. Objects are counted within blocks first; an object's times in a block are kept only if they are few enough, so a hot object is a row a block."""
    part = trace.groupBy("obj_id", F.floor(F.col("vtime") / block).alias("block")).agg(F.count("*").alias("n"), F.collect_list("vtime").alias("times"))
    part = part.select("obj_id", "n", F.when(F.col("n") <= most, F.col("times")).alias("times"))
    wanted = part.groupBy("obj_id").agg(F.sum("n").alias("all")).filter(F.col("all").between(least, most)).select("obj_id")
    lists = part.join(wanted, "obj_id").groupBy("obj_id").agg(F.flatten(F.collect_list("times")).alias("times"))
    return lists.select("obj_id", F.array_sort("times").alias("times"))


def associations(trace: DataFrame, lookahead: int = 20, least: int = 2, most: int = 8, confidence: int = 1, block: int = BLOCK) -> DataFrame:
    """obj_id, next_id, n_far: pairs of rare objects whose requests come close to each other, one by one.

    next_id's first request comes at most `lookahead` requests after obj_id's; their numbers of requests differ by at most
    `confidence`; of the further requests, in order, at most `confidence` (n_far) are more than `lookahead` apart. Of the objects
    with a fitting number the first one is taken, and any with a request directly beside obj_id's of the same place.
    First requests are places of their own, so an object has at most `lookahead` partners.
    """
    rows = rare_objects(trace, least, most, block).select("obj_id", "times", F.get("times", F.lit(0)).alias("first"))
    near = F.collect_list(F.struct("first", "obj_id", "times")).over(Window.partitionBy("block").orderBy("first").rangeBetween(1, lookahead))
    seen = _overlapping(rows, "first", lookahead, block).withColumn("near", near).filter(F.floor(F.col("first") / block) == F.col("block"))
    fit = F.filter("near", lambda x: F.abs(F.size(x["times"]) - F.size("times")) <= confidence)
    pairs = seen.select("obj_id", "times", F.posexplode(F.array_sort(fit)).alias("place", "other"))
    # Gaps of requests of the same number; the shorter list ends them.
    gaps = F.filter(F.zip_with("times", "other.times", lambda a, b: F.abs(a - b)), lambda g: g.isNotNull())
    pairs = pairs.select("obj_id", F.col("other.obj_id").alias("next_id"), "place", gaps.alias("gaps"))
    further = F.slice("gaps", F.lit(2), F.size("gaps"))
    beside = F.exists(F.when(F.size("gaps") > 1, further).otherwise(F.col("gaps")), lambda g: g == 1)
    far = F.size(F.filter(further, lambda g: g > lookahead)).cast("long")
    return pairs.filter(((F.col("place") == 0) | beside) & (far <= confidence)).select("obj_id", "next_id", far.alias("n_far"))
