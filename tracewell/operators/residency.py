"""How long objects stay in an LRU cache: residencies, eviction ages, shares of the cache, and expiry.

An LRU cache evicts in the order of last accesses. So nothing is replayed: residencies in the order of their last access,
and misses in the order of the trace, are two sequences of bytes (or of ones) that grow; a residency ends at the first
miss whose running sum of inserted bytes is over the cache's size and what went before. The two meet in one sort by these
sums. Sorts are by range and continue across partitions by a row a partition; no task sees all rows of an object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..sources.tables import with_vtime
from .distance import stack_distances
from .lru import missed
from .prep import timed
from .weighted import byte_distances, byte_hit

LOG_BASE = 1.08  # fixed value: eviction ages are counted by powers of it


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted by ranges, with part and place: a table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    return placed.withColumn("part", F.shiftright("place", 33))


def running_sum(rows: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """rows with the sum of a column over all rows up to and with their own, in an order."""
    placed = _placed(rows, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = placed.groupBy("part").agg(F.sum(value).alias("own")).select("part", (F.sum("own").over(before) - F.col("own")).alias("base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each partition of the sort.
    return placed.withColumn(out, F.sum(value).over(inside)).join(F.broadcast(parts), "part").withColumn(out, F.col(out) + F.col("base")).select(*rows.columns, out)


def following(queries: DataFrame, points: DataFrame, *order: str) -> DataFrame:
    """queries with `point`: the first row of points, as a struct, that comes at the same place or later in an order whose columns both have (null if there is none)."""
    row, point = F.struct(*queries.columns), F.struct(*points.columns)
    both = queries.select(*order, F.lit(0).alias("kind"), row.alias("query"), F.lit(None).cast(points.select(point.alias("x")).schema["x"].dataType).alias("point"))
    both = both.unionByName(points.select(*order, F.lit(1).alias("kind"), F.lit(None).cast(queries.select(row.alias("x")).schema["x"].dataType).alias("query"), point.alias("point")))
    placed = _placed(both, *order, "kind")
    back = Window.partitionBy("part").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("part").agg(F.min_by(F.when(F.col("point").isNotNull(), F.col("point")), F.when(F.col("point").isNotNull(), F.col("place"))).alias("first"))
    first = first.select("part", F.last("first", ignorenulls=True).over(later).alias("next"))
    met = placed.withColumn("point", F.last("point", ignorenulls=True).over(back)).filter("kind = 0").join(F.broadcast(first), "part")
    return met.select("query.*", F.coalesce("point", "next").alias("point"))


def cached_rows(trace: DataFrame, size: int) -> DataFrame:
    """vtime, obj_id, prev_vtime, room (1), miss: what a cache of so many objects does."""
    return stack_distances(trace).select("vtime", "obj_id", "prev_vtime", F.lit(1).cast("long").alias("room"), missed(size).alias("miss"))


def cached_byte_rows(trace: DataFrame, size: int, overhead: int = 0) -> DataFrame:
    """As cached_rows for a cache of so many bytes; requests for objects that are larger than it are left out, as they change nothing in it."""
    d = byte_distances(trace, [size], overhead)
    return d.select("vtime", "obj_id", "prev_vtime", "room", (~byte_hit(0, size)).alias("miss")).filter(F.col("room") <= size)


def residencies(rows: DataFrame, size: int) -> DataFrame:
    """obj_id, from_vtime (the miss that brings it in), last_vtime (its last hit, or that miss), evicted_at (the request that throws it out; null if none does), n_access, room. rows: as cached_rows gives."""
    rows = stored(rows, "cached")
    came = rows.filter("prev_vtime is not null").select(F.col("prev_vtime").alias("vtime"), F.col("miss").alias("next_missed"))
    both = rows.join(came, "vtime", "left").select("vtime", "obj_id", "room", "miss", F.coalesce("next_missed", F.lit(True)).alias("end"))
    # An object's misses and the ends of its residencies alternate, so that they pair up by their numbers in this order.
    ordered = stored(with_vtime(both.withColumnRenamed("vtime", "own"), "obj_id", "own").select(F.col("vtime").alias("at"), "own", "obj_id", "room", "miss", "end"), "by-object")
    starts = with_vtime(ordered.filter("miss").select("at", F.col("own").alias("from_vtime")), "at").select(F.col("vtime").alias("n"), F.col("at").alias("from_at"), "from_vtime")
    ends = with_vtime(ordered.filter("end").select("at", "obj_id", "room", F.col("own").alias("last_vtime")), "at").select(F.col("vtime").alias("n"), "at", "obj_id", "room", "last_vtime")
    held = starts.join(ends, "n").select("obj_id", "from_vtime", "last_vtime", (F.col("at") - F.col("from_at") + 1).alias("n_access"), "room")
    gone = running_sum(held, "room", "left_with", "last_vtime")
    # Inserted bytes have to pass the cache's size and the bytes that left before.
    queries = gone.withColumn("value", F.col("left_with") - F.col("room") + size + 1).drop("left_with")
    points = running_sum(rows.filter("miss").select("vtime", "room"), "room", "value", "vtime").select("value", "vtime")
    met = following(queries, points, "value")
    return met.select("obj_id", "from_vtime", "last_vtime", F.col("point.vtime").alias("evicted_at"), "n_access", "room")


def eviction_statistics(held: DataFrame) -> DataFrame:
    """kind, bucket, cnt of what was evicted: `age`, requests from insertion to eviction, and `idle`, from the last access, by powers of LOG_BASE; `freq`, accesses while it was held."""
    power = lambda x: F.ceil(F.log(x.cast("double")) / F.log(F.lit(LOG_BASE))).cast("long")
    out = held.filter("evicted_at is not null")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bucket")) for k, b in (("age", power(F.col("evicted_at") - F.col("from_vtime"))), ("idle", power(F.col("evicted_at") - F.col("last_vtime"))), ("freq", F.col("n_access")))])
    return out.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.bucket").agg(F.count("*").alias("cnt"))


def cache_shares(held: DataFrame, sources: DataFrame, n_req: int, interval: int) -> DataFrame:
    """interval, source, cached, useful, share: at the end of each interval of requests what a source has in the cache (room), what of it will be asked for again before it goes, and its part of all that is cached. sources: vtime, source of the request that brings an object in. Rows are sources by intervals: a picture, for which the interval is chosen."""
    at = lambda c: F.floor((F.col(c) - 1) / interval)
    none = F.lit(0).cast("long")
    events = F.array(
        F.struct(at("from_vtime").alias("interval"), F.col("room").alias("cached"), F.col("room").alias("useful")),
        F.struct(at("last_vtime").alias("interval"), none.alias("cached"), (-F.col("room")).alias("useful")),
        F.struct(at("evicted_at").alias("interval"), (-F.col("room")).alias("cached"), none.alias("useful")),
    )
    named = held.join(sources.withColumnRenamed("vtime", "from_vtime"), "from_vtime")
    changes = named.select("source", F.explode(events).alias("e")).filter("e.interval is not null").groupBy("source", "e.interval").agg(F.sum("e.cached").alias("cached"), F.sum("e.useful").alias("useful"))
    changes = stored(changes, "changes")
    spine = changes.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_req - 1) // interval).cast("long"))).alias("interval"))
    up = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spine.join(changes, ["source", "interval"], "left").na.fill(0, ["cached", "useful"]).select("interval", "source", F.sum("cached").over(up).alias("cached"), F.sum("useful").over(up).alias("useful"))
    return rows.withColumn("share", F.round(F.try_divide(F.col("cached"), F.sum("cached").over(Window.partitionBy("interval"))), 6))


def expiring_misses(trace: DataFrame, sizes: list[int]) -> DataFrame:
    """cache_size, n_req, n_miss, n_expired, miss_ratio of LRU caches of so many objects, where an object that comes in with a ttl above 0 is gone for requests more than ttl seconds later. It is only found out when it is asked for, so the order of the cache is that without expiry.

    An access that misses brings the object in; the next one that misses is the first later than its expiry, unless the
    object was evicted before. So from each access a pointer leads to the next miss if this one is a miss. Misses are what
    pointers reach from first accesses and evictions; each round doubles the pointers' reach.
    """
    t = stored(timed(trace).select("vtime", "obj_id", "t", "ttl"), "timed")
    d = stack_distances(t.select("vtime", "obj_id")).select("vtime", "obj_id", "stack_dist")
    late = t.filter("ttl > 0").select("obj_id", (F.col("t") + F.col("ttl") + 1).alias("t"), "vtime")
    found = following(late, t.select("obj_id", "t", "vtime"), "obj_id", "t")
    pointers = stored(found.filter(F.col("point.obj_id") == F.col("obj_id")).select("vtime", F.col("point.vtime").alias("next")), "expiries")
    # Lives: an access's number is that of its object's last first access or eviction, for each size.
    by_size = F.explode(F.array(*[F.struct(F.lit(c).alias("cache_size"), missed(c).cast("long").alias("cold")) for c in sizes]))
    each = d.select("vtime", "obj_id", by_size.alias("s")).select("s.cache_size", "obj_id", "vtime", "s.cold")
    lives = stored(running_sum(each, "cold", "life", "cache_size", "obj_id", "vtime"), "lives")
    starts = pointers.join(lives.select("cache_size", "vtime", "life"), "vtime")
    aims = lives.select("cache_size", F.col("vtime").alias("next"), F.col("life").alias("next_life"))
    jump = stored(starts.join(aims, ["cache_size", "next"]).filter("life = next_life").select("cache_size", "vtime", "next"), "jumps")
    reached = stored(lives.filter("cold = 1").select("cache_size", "vtime"), "reached")
    # Each round halves the longest chain that is left; chains are no longer than an object's accesses.
    while jump.head(1):
        onward = reached.join(jump, ["cache_size", "vtime"]).select("cache_size", F.col("next").alias("vtime"))
        reached = stored(reached.unionByName(onward).distinct(), "reached")
        jump = stored(jump.join(jump.select("cache_size", F.col("vtime").alias("next"), F.col("next").alias("then")), ["cache_size", "next"]).select("cache_size", "vtime", F.col("then").alias("next")), "jumps")
    cold = lives.groupBy("cache_size").agg(F.count("*").alias("n_req"), F.sum("cold").alias("n_cold"))
    n = reached.groupBy("cache_size").agg(F.count("*").alias("n_miss"))
    return cold.join(n, "cache_size").select(F.col("cache_size").cast("long").alias("cache_size"), "n_req", "n_miss", (F.col("n_miss") - F.col("n_cold")).alias("n_expired"), F.round(F.col("n_miss") / F.col("n_req"), 6).alias("miss_ratio"))
