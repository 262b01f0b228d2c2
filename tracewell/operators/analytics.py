"""Workload analyses of a trace. Each takes a trace (or an annotated one) and returns a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import log_bucket, step_bucket
from ..schema import WRITES
from ..sources.tables import with_vtime
from .prep import SLICE, scalar, with_neighbours

HOUR, DAY = 3600, 86400
#: Ranks in a piece.
RANKS = 1 << 16


def _n() -> Column:
    return F.count("*").alias("cnt")


def objects(a: DataFrame) -> DataFrame:
    """obj_id, freq, first_size, create_t, last_t, bytes of a trace with t."""
    return a.groupBy("obj_id").agg(F.count("*").alias("freq"), F.min_by("obj_size", "vtime").alias("first_size"), F.min("t").alias("create_t"), F.max("t").alias("last_t"), F.sum("obj_size").alias("bytes"))


def trace_stat(a: DataFrame) -> DataFrame:
    per = objects(a)
    return per.agg(
        F.sum("freq").alias("n_req"), F.count("*").alias("n_obj"), F.sum("bytes").alias("req_bytes"), F.sum("first_size").alias("obj_bytes"),
        F.round(F.count("*") / F.sum("freq"), 6).alias("cold_miss_ratio"), F.round(F.sum("first_size") / F.sum("bytes"), 6).alias("byte_cold_miss_ratio"),
        F.floor(F.sum("bytes") / F.sum("freq")).alias("mean_req_size"), F.floor(F.sum("first_size") / F.count("*")).alias("mean_obj_size"),
        F.round(F.sum("freq") / F.count("*"), 6).alias("mean_freq"), (F.max("last_t") - F.min("create_t")).alias("time_span"),
    )


def x_hit(a: DataFrame, most: int = 8) -> DataFrame:
    """Objects with 1 ... most accesses, and their share of all objects."""
    freqs = objects(a).groupBy("freq").agg(F.count("*").alias("n"))
    total = scalar(freqs, F.sum("n"))
    spine = a.sparkSession.range(1, most + 1).select(F.col("id").alias("freq"))
    return spine.join(freqs, "freq", "left").select("freq", F.coalesce("n", F.lit(0)).alias("n_obj"), F.round(F.coalesce("n", F.lit(0)) / total, 6).alias("ratio"))


def top_popular(a: DataFrame, k: int = 8) -> DataFrame:
    """The k largest frequencies, ties by id."""
    total = scalar(a, F.count("*"))
    best = objects(a).orderBy(F.col("freq").desc(), "obj_id").limit(k)
    return best.select("obj_id", "freq", F.round(F.col("freq") / total, 6).alias("ratio"))


def op_stat(a: DataFrame) -> DataFrame:
    total = scalar(a, F.count("*"))
    return a.groupBy("op").agg(_n(), F.count(F.when(F.col("op").isin(WRITES), 1)).alias("n_write"), F.count(F.when(F.col("overwrite"), 1)).alias("n_overwrite"), F.count(F.when(F.col("op") == "delete", 1)).alias("n_delete")).withColumn("ratio", F.round(F.col("cnt") / total, 6))


def req_rate(a: DataFrame, w: int = HOUR, include_partial: bool = False) -> DataFrame:
    """Per window of w seconds: requests, bytes, objects and new objects, each per second (whole numbers). Empty windows are 0; the last, incomplete window is left out unless asked for."""
    per = a.groupBy(F.floor(F.col("t") / w).alias("win")).agg(
        F.count("*").alias("n"), F.sum("obj_size").alias("b"), F.count(F.when(F.col("first_seen_in_window"), 1)).alias("o"), F.count(F.when(F.col("compulsory_miss"), 1)).alias("f")
    )
    last = F.floor(F.max("t") / w) - (0 if include_partial else 1)
    spine = a.agg(last.alias("last")).filter("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("win"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.floor(z(c) / w)
    return spine.join(per, "win", "left").select("win", z("n").alias("n_req"), rate("n").alias("req_rate"), rate("b").alias("byte_rate"), rate("o").alias("obj_rate"), rate("f").alias("first_seen_rate"))


def req_rate_shifted(trace_t: DataFrame, w: int = HOUR) -> DataFrame:
    """Requests per window where the request that opens a window still counts for the one before it."""
    before = trace_t.select((F.col("vtime") + 1).alias("vtime"), F.col("t").alias("last_t"))
    got = trace_t.join(before, "vtime", "left").groupBy(F.floor(F.coalesce("last_t", F.lit(0)) / w).alias("win")).agg(_n())
    spine = trace_t.agg((F.floor(F.max("t") / w) - 1).alias("last")).filter("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("win"))
    return spine.join(got, "win", "left").select("win", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def req_rate_summary(a: DataFrame, w: int = HOUR) -> DataFrame:
    r = req_rate(a, w)
    ends = [f(c).alias(f"{name}_{c}") for c in ("req_rate", "byte_rate", "obj_rate") for name, f in (("min", F.min), ("max", F.max))]
    return r.agg(F.count("*").alias("n_windows"), *ends, (F.count("*") < 10).alias("few_windows"))


def trimmed(rows: DataFrame, value: str, order: str, first: int, last: int) -> DataFrame:
    """Mean and deviation of a column without its first and last rows in an order, 0 if nothing is left; its median over all rows."""
    numbered = with_vtime(rows.select(F.col(order).alias("own"), F.col(value).alias("value")), "own")
    inside = numbered.withColumn("x", F.when((F.col("vtime") > first) & (F.col("vtime") <= scalar(numbered, F.count("*")) - last), F.col("value")))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    # The median is the mean of the one or two rows in the middle, from an order by value that no task sees whole.
    by_value = with_vtime(rows.select(F.col(value).alias("value")).filter("value is not null"), "value")
    twice = scalar(by_value, F.count("*")) + 1
    middle = by_value.filter((F.col("vtime") >= F.floor(twice / 2)) & (F.col("vtime") <= F.ceil(twice / 2)))
    return inside.agg(F.count("*").alias("n_rows"), F.count("x").alias("n_kept"), zero(F.avg("x")).alias("mean"), zero(F.stddev_pop("x")).alias("std")).withColumn("median", zero(scalar(middle, F.avg("value"))))


def size_dist(a: DataFrame) -> DataFrame:
    """Requests and objects (by first size) of each size."""
    req = a.groupBy(F.col("obj_size").alias("size")).agg(F.count("*").alias("n_req"), F.count(F.when(F.col("compulsory_miss"), 1)).alias("n_obj"))
    return req


def size_heatmap(a: DataFrame, w: int = HOUR) -> DataFrame:
    return a.groupBy(F.floor(F.col("t") / w).alias("win"), log_bucket(F.col("obj_size")).alias("bucket")).agg(F.count("*").alias("n_req"), F.count(F.when(F.col("first_seen_in_window"), 1)).alias("n_obj"))


def reuse_rt(a: DataFrame, step: int = 5) -> DataFrame:
    return a.groupBy(step_bucket(F.col("rtime_since_last"), step).alias("bucket")).agg(_n())


def _reuse_v() -> Column:
    return F.when(F.col("vtime_since_last") < 0, F.lit(-1).cast("long")).otherwise(log_bucket(F.col("vtime_since_last")))


def reuse_vt(a: DataFrame) -> DataFrame:
    return a.groupBy(_reuse_v().alias("bucket")).agg(_n())


def reuse_heatmap(a: DataFrame, w: int = DAY, step: int = 300) -> DataFrame:
    """Warm requests per window and bucket, for both kinds of distance."""
    warm = a.filter(~F.col("compulsory_miss")).withColumn("win", F.floor(F.col("t") / w))
    kinds = F.array(F.struct(F.lit("rtime").alias("kind"), step_bucket(F.col("rtime_since_last"), step).alias("bucket")), F.struct(F.lit("vtime").alias("kind"), _reuse_v().alias("bucket")))
    return warm.select("win", F.explode(kinds).alias("k")).groupBy("win", "k.kind", "k.bucket").agg(_n())


def access_pattern(a: DataFrame, one_in: int = 101) -> DataFrame:
    """Access times of one object in so many, a row for each access, with the object's first one."""
    return a.filter(F.pmod("obj_id", F.lit(one_in)) == 0).select("obj_id", "first_vtime", "vtime", "t")


def popularity(a: DataFrame) -> DataFrame:
    """How many objects have each frequency."""
    return objects(a).groupBy("freq").agg(F.count("*").alias("n_obj"))


def _ranked(a: DataFrame) -> DataFrame:
    """freq, rank (from 1, most frequent first) and n objects that share them, as (first rank, n): ranks come from the counts of frequencies, one row each."""
    counts = popularity(a)
    down = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("last_rank", F.sum("n_obj").over(down)).withColumn("first_rank", F.col("last_rank") - F.col("n_obj") + 1)
    # Many objects may share a frequency: their ranks are made in pieces, which are dealt to all tasks.
    pieces = ends.select("freq", "last_rank", F.explode(F.sequence("first_rank", "last_rank", F.lit(RANKS))).alias("from"))
    pieces = pieces.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "freq", "from")
    return pieces.select("freq", F.explode(F.sequence("from", F.least("last_rank", F.col("from") + RANKS - 1))).alias("rank"))


def zipf(a: DataFrame) -> DataFrame:
    """Slope and fit of log frequency against log rank, with what the fit asks for."""
    r = _ranked(a)
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("freq").cast("double"))
    return r.agg(F.round(-F.regr_slope(y, x), 6).alias("alpha"), F.round(F.regr_r2(y, x), 6).alias("r2"), (F.count("*") >= 200).alias("fit_ok"), (F.max("freq") < 200).alias("warn_low_freq"))


def popularity_decay(a: DataFrame, w: int = DAY, warmup: int = DAY) -> DataFrame:
    """Distinct objects per window and window of creation, both after the warm-up; complete windows only."""
    last = scalar(a, F.floor(F.max("t") / w))
    kept = a.filter((F.col("t") >= warmup) & (F.col("create_rtime") >= warmup))
    per = kept.groupBy(F.floor(F.col("t") / w).alias("win"), F.floor(F.col("create_rtime") / w).alias("create_win"))
    return per.agg(F.countDistinct("obj_id").alias("n_obj")).filter(F.col("win") < last)


def popularity_decay_norm(a: DataFrame, w: int = DAY, warmup: int = DAY) -> DataFrame:
    d = popularity_decay(a, w, warmup)
    first = F.first("n_obj").over(Window.partitionBy("create_win").orderBy("win"))
    return d.select("create_win", (F.col("win") - F.col("create_win")).alias("age"), F.round(F.col("n_obj") / first, 6).alias("share"))


def ttl_dist(a: DataFrame) -> DataFrame:
    total = scalar(a, F.count("*"))
    return a.filter("ttl > 0").groupBy("ttl").agg(_n()).select("ttl", "cnt", (F.col("cnt") > 0.01 * total).alias("frequent"))


def lifetime(a: DataFrame, created_within: int = DAY) -> DataFrame:
    """Life spans of objects that the first day creates, in steps of 10 s and of 100 requests."""
    per = a.filter(F.col("create_rtime") < created_within).groupBy("obj_id").agg((F.max("t") - F.min("t")).alias("rt"), (F.max("vtime") - F.min("vtime")).alias("vt"))
    kinds = F.array(F.struct(F.lit("rtime").alias("kind"), (F.floor(F.col("rt") / 10) * 10).alias("bucket")), F.struct(F.lit("vtime").alias("kind"), (F.floor(F.col("vt") / 100) * 100).alias("bucket")))
    return per.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.bucket").agg(_n())


def prob_at_age(a: DataFrame, w: int = DAY, warmup: int = DAY) -> DataFrame:
    """Requests by time since the last access and since creation, in windows."""
    return a.filter(F.col("t") >= warmup).groupBy(F.floor(F.greatest(F.col("rtime_since_last"), F.lit(0)) / w).alias("access_age"), F.floor((F.col("t") - F.col("create_rtime")) / w).alias("create_age")).agg(_n())


def create_future_reuse(a: DataFrame, warmup: int = DAY) -> DataFrame:
    """By age since creation: requests that are followed by another one and requests that are the last, for objects created in the day after the warm-up."""
    freq = F.col("before") + F.col("rank")
    made = a.filter((F.col("create_rtime") >= warmup) & (F.col("create_rtime") <= warmup + DAY)).withColumn("slice", F.floor(F.col("vtime") / SLICE))
    # An object's requests are numbered within slices, and slices among one another.
    over_slices = Window.partitionBy("obj_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = made.groupBy("obj_id", "slice").agg(F.count("*").alias("n")).select("obj_id", "slice", F.coalesce(F.sum("n").over(over_slices), F.lit(0)).alias("before"))
    made = made.withColumn("rank", F.row_number().over(Window.partitionBy("obj_id", "slice").orderBy("vtime"))).join(slices, ["obj_id", "slice"])
    age = F.col("t") - F.col("create_rtime")
    bucket = F.when(age < HOUR, age).otherwise(F.floor(age / 5) * 5)
    return made.groupBy(bucket.alias("age"), F.col("next_vtime").isNotNull().alias("reused")).agg(_n(), F.sum(freq.cast("long")).alias("sum_freq"), F.sum(F.greatest(F.col("rtime_since_last"), F.lit(0))).alias("sum_access_age"))


def size_change(a: DataFrame) -> DataFrame:
    """Overwrites by change of size: relative to the old size in tenths (between -1 and 2), and absolute in powers of two, signed."""
    o = a.filter("overwrite").withColumn("d", F.col("obj_size") - F.col("prev_size"))
    # From size 0, any growth is beyond the last tenth.
    tenths = F.coalesce(F.try_divide(10 * F.col("d"), F.col("prev_size")), F.when(F.col("d") > 0, 20.0).otherwise(0.0))
    rel = F.greatest(F.lit(-10), F.least(F.lit(20), F.floor(tenths))).cast("long")
    ab = (F.signum("d") * F.when(F.col("d") == 0, 0).otherwise(1 + F.floor(F.log(F.abs("d").cast("double")) / F.log(F.lit(2.0)) + 1e-9))).cast("long")
    kinds = F.array(F.struct(F.lit("relative").alias("kind"), rel.alias("bucket")), F.struct(F.lit("absolute").alias("kind"), ab.alias("bucket")))
    return o.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.bucket").agg(_n())


#: Upper edges of the bins of relative change on either side; beyond the last one there is one more.
CHANGE_EDGES = [0.0001, 0.0002, 0.0005, 0.0008, 0.001, 0.002, 0.005, 0.008, 0.01, 0.02, 0.05, 0.08, 0.1]


def size_change_fine(a: DataFrame) -> DataFrame:
    """Overwrites by relative change of size in 29 bins: 0 for none, 1 to 14 for growth and -1 to -14 for shrinkage, by CHANGE_EDGES."""
    d = F.col("obj_size") - F.col("prev_size")
    rel = F.when(d == 0, 0.0).otherwise(F.coalesce(F.try_divide(d, F.col("prev_size")), F.lit(float("inf"))))
    edge = F.lit(1)
    for e in CHANGE_EDGES:
        edge = edge + (F.abs("rel") >= e).cast("int")
    bucket = F.when(F.abs("rel") < 0.00001, 0).otherwise(F.signum("rel") * edge).cast("long")
    return a.filter("overwrite").select(rel.alias("rel")).groupBy(bucket.alias("bucket")).agg(_n())


def write_reuse(a: DataFrame, step: int = HOUR) -> DataFrame:
    """Time from an object's latest write to each later access, by kind of access."""
    rows = a.withColumn("slice", F.floor(F.col("vtime") / SLICE)).withColumn("written", F.when(F.col("op").isin(WRITES), F.col("t")))
    so_far = Window.partitionBy("obj_id", "slice").orderBy("vtime").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("obj_id", "slice").agg(F.max_by("written", F.when(F.col("written").isNotNull(), F.col("vtime"))).alias("last"))
    earlier = Window.partitionBy("obj_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("obj_id", "slice", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    wrote = F.coalesce(F.last("written", ignorenulls=True).over(so_far), "before")
    kind = F.when(F.col("op").isin(WRITES), "overwrite").when(F.col("op") == "delete", "remove").otherwise("read")
    return rows.join(slices, ["obj_id", "slice"]).withColumn("wrote", wrote).filter("wrote is not null").groupBy(kind.alias("kind"), F.floor((F.col("t") - F.col("wrote")) / step).alias("bucket")).agg(_n())


#: Operations that start an object's life anew, and those that read.
PUTS, READS = ["set", "replace"], ["get", "gets", "incr", "decr"]


def write_future_reuse(trace_t: DataFrame, fine: int = HOUR, step: int = 5) -> DataFrame:
    """By age since an object's latest write, until it is deleted: requests that another read follows and requests that end the reuse, the reads since the write and the time since the latest of them.

    A write or delete is counted at the age of the life that it ends. A write has no reads behind it; a delete has those of that life.
    """
    rows = with_neighbours(trace_t, "op", "t").drop("prev", "first").withColumn("slice", F.floor(F.col("vtime") / SLICE))
    ends, read = F.col("op").isin([*PUTS, "delete"]), F.col("op").isin(READS)
    so_far = Window.partitionBy("obj_id", "slice").orderBy("vtime").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reads", F.count(F.when(read, 1)).over(so_far))
    end, seen = F.when(ends, F.struct("vtime", "op", "t", "reads")), F.when(read, F.struct("vtime", "t"))
    # What a slice leaves behind, and what an object brings into a slice.
    slices = rows.groupBy("obj_id", "slice").agg(F.count(F.when(read, 1)).alias("n"), F.max(end).alias("end"), F.max(seen).alias("seen"))
    earlier = Window.partitionBy("obj_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    whole = lambda e: F.when(e.isNotNull(), F.struct(e["vtime"].alias("vtime"), e["op"].alias("op"), e["t"].alias("t"), (e["reads"] + F.col("base")).alias("reads")))
    slices = slices.select("obj_id", "slice", "base", F.last(whole(F.col("end")), ignorenulls=True).over(earlier).alias("end_before"), F.last("seen", ignorenulls=True).over(earlier).alias("seen_before"))
    rows = rows.withColumn("end", F.last(end, ignorenulls=True).over(so_far)).withColumn("seen", F.last(seen, ignorenulls=True).over(so_far)).join(slices, ["obj_id", "slice"])
    rows = rows.withColumn("end", F.coalesce(whole(F.col("end")), "end_before")).withColumn("seen", F.coalesce("seen", "seen_before")).filter(F.col("end.op").isin(PUTS))
    put = F.col("op").isin(PUTS)
    freq = F.when(put, 0).otherwise(F.col("base") + F.col("reads") - F.col("end.reads"))
    since = F.when(put | F.col("seen").isNull() | (F.col("seen.vtime") < F.col("end.vtime")), 0).otherwise(F.col("t") - F.col("seen.t"))
    age = F.col("t") - F.col("end.t")
    reused = ~ends & F.coalesce(~F.col("next.op").isin([*WRITES, "delete"]), F.lit(False))
    return rows.groupBy(F.when(age < fine, age).otherwise(F.floor(age / step) * step).alias("age"), reused.alias("reused")).agg(_n(), F.sum(freq).alias("sum_freq"), F.sum(since).alias("sum_access_age"))


def cdf(hist: DataFrame, key: str, count: str) -> DataFrame:
    """Running share of a histogram."""
    up = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.select(key, F.round(F.sum(count).over(up) / F.sum(count).over(Window.partitionBy()), 6).alias("cdf"))


def one_hit_ratio(a: DataFrame, every: int = 100) -> DataFrame:
    """Whenever the number of objects reaches a multiple of `every`, the share of them with one access so far."""
    # +1 at a first access, -1 at a second; only those rows matter.
    prev_first = F.col("vtime_since_last") == F.col("vtime") - F.col("first_vtime")
    change = F.when(F.col("compulsory_miss"), 1).when(prev_first, -1).otherwise(0)
    rows = a.withColumn("change", change).filter("change <> 0").select("vtime", "change", F.floor(F.col("vtime") / 65536).alias("block"))
    new = (F.col("change") > 0).cast("long")
    per = rows.groupBy("block").agg(F.sum("change").alias("c"), F.sum(new).alias("o"))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select("block", (F.sum("c").over(up) - F.col("c")).alias("c0"), (F.sum("o").over(up) - F.col("o")).alias("o0"))
    inside = Window.partitionBy("block").orderBy("vtime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("c1", F.sum("change").over(inside)).withColumn("o1", F.sum(new).over(inside)).join(per, "block")
    run = run.select("vtime", "change", (F.col("c0") + F.col("c1")).alias("ones"), (F.col("o0") + F.col("o1")).alias("n_obj"))
    return run.filter((F.col("change") > 0) & (F.col("n_obj") % every == 0)).select("n_obj", "vtime", F.round(F.col("ones") / F.col("n_obj"), 6).alias("ratio"))


def obj_reuse_stat(a: DataFrame) -> DataFrame:
    return a.groupBy("obj_id").agg(F.min("vtime").alias("first_vtime"), (F.count("*") - 1).alias("n_reuse"), F.round((F.max("t") - F.min("t")) / F.greatest(F.count("*") - 1, F.lit(1)), 6).alias("mean_reuse_time"))


def group_compare(a: DataFrame, groups: int = 16) -> DataFrame:
    """Mean and deviation of the objects' accesses in groups by time of creation and in groups by id."""
    o = objects(a)
    width = scalar(o, F.floor(F.max("create_t") / groups) + 1)
    kinds = F.array(F.struct(F.lit("created").alias("kind"), F.floor(F.col("create_t") / width).alias("grp")), F.struct(F.lit("id").alias("kind"), F.pmod("obj_id", F.lit(groups)).alias("grp")))
    return o.select("freq", F.explode(kinds).alias("k")).groupBy("k.kind", "k.grp").agg(_n(), F.round(F.avg("freq"), 6).alias("mean_freq"), F.round(F.stddev_pop("freq"), 6).alias("std_freq"))


def op_rollup(a: DataFrame) -> DataFrame:
    """Requests and bytes by namespace and operation, with totals."""
    return a.rollup("ns", "op").agg(_n(), F.sum("obj_size").alias("bytes"))


def interval_heatmap(d: DataFrame, value: str, interval: int) -> DataFrame:
    """A distance by intervals of vtime and logarithmic bucket; first accesses are left out."""
    return d.filter(F.col(value) >= 0).groupBy(F.floor((F.col("vtime") - 1) / interval).alias("interval"), log_bucket(F.col(value) + 1).alias("bucket")).agg(_n())


def heatmap_hit_ratio_window(d: DataFrame, size: int, interval: int) -> DataFrame:
    """Hit ratio of an LRU cache that is empty at the start of one interval and runs to the end of another, for all pairs of intervals. d: vtime, prev_vtime, stack_dist.

    Requests become one count for each pair (interval of the access before, own interval); the picture is made of running sums over these.
    """
    own, before = F.floor((F.col("vtime") - 1) / interval), F.floor((F.col("prev_vtime") - 1) / interval)
    hit = (F.col("stack_dist") >= 0) & (F.col("stack_dist") < size)
    counts = d.groupBy(own.alias("end_interval"), F.when(hit, before).alias("start_interval")).agg(F.count("*").alias("n"))
    per = counts.groupBy("end_interval").agg(F.sum("n").alias("n_req"))
    hits = counts.filter("start_interval is not null").select("start_interval", "end_interval", F.col("n").alias("n_hit"))
    cells = per.withColumn("start_interval", F.explode(F.sequence(F.lit(0).cast("long"), "end_interval"))).join(hits, ["start_interval", "end_interval"], "left").na.fill(0, ["n_hit"])
    down = Window.partitionBy("end_interval").orderBy(F.col("start_interval").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = Window.partitionBy("start_interval").orderBy("end_interval").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("n_hit", F.sum("n_hit").over(down))
    return cells.select("start_interval", "end_interval", F.round(F.sum("n_hit").over(on) / F.sum("n_req").over(on), 6).alias("hit_ratio"))


def heatmap_hit_ratio_size(d: DataFrame, size: int, step: int, interval: int, decay: float = 0.0) -> DataFrame:
    """Hit ratio of LRU caches of 0, step, 2 * step ... up to size objects in each interval; with a decay, so much of the ratio before it goes into each interval's. d: vtime, stack_dist."""
    counts = d.groupBy(F.floor((F.col("vtime") - 1) / interval).alias("interval"), F.when(F.col("stack_dist") >= 0, F.floor(F.col("stack_dist") / step) + 1).alias("k")).agg(F.count("*").alias("n"))
    per = counts.groupBy("interval").agg(F.sum("n").alias("n_req"))
    cells = per.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size // step).cast("long")))).join(counts, ["interval", "k"], "left").na.fill(0, ["n"])
    up = Window.partitionBy("interval").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratios = cells.select((F.col("k") * step).alias("cache_size"), "interval", (F.sum("n").over(up) / F.col("n_req")).alias("h"))
    if not decay:
        return ratios.select("cache_size", "interval", F.round("h", 6).alias("hit_ratio"))
    # An array holds one size's intervals, as many as the picture has.
    series = ratios.groupBy("cache_size").agg(F.sort_array(F.collect_list(F.struct("interval", "h"))).alias("s"))
    folded = F.aggregate("s", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["h"]).otherwise(F.try_element_at(acc, F.lit(-1)) * decay + (1 - decay) * x["h"]))))
    return series.select("cache_size", F.explode(F.arrays_zip("s", folded.alias("m"))).alias("z")).select("cache_size", "z.s.interval", F.round("z.m", 6).alias("hit_ratio"))
