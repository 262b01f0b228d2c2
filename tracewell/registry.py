"""Queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics as an
from .operators import distance as di
from .operators import association, lru, prep, residency, sampled, sketches, topology, weighted
from .plans.oracle import ORACLE
from .plans.storage import shared_dir, stored
from .schema import parse_sizes
from .sources import formats, trace_source
from .sources.tables import skewed_trace, trace_from_events, trace_from_orders, with_vtime

TRACES = {"events": trace_from_events, "skew": skewed_trace, "orders": trace_from_orders}
SIZES = [10, 50, 100]
BYTES = 5000


def _on(trace: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(TRACES[trace](spark, sf_dir))


def _annotated(trace: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(prep.annotate(TRACES[trace](spark, sf_dir)))


def _timed(trace: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(prep.timed(TRACES[trace](spark, sf_dir)))


def _servers(t: DataFrame) -> DataFrame:
    """Namespaces stand for servers."""
    return t.select(F.col("ns").alias("server")).distinct()


def _written_and_read(spark: SparkSession, sf_dir: str, **options: int | bool) -> DataFrame:
    """The events as a packed file with next accesses, read back with options of as_requests."""
    parts = stored(formats.write_binary(prep.oracle_annotate(trace_from_events(spark, sf_dir)), shared_dir(spark, "packed")), "parts")
    back = formats.read_parts(spark, parts, "oracleGeneral")
    return formats.as_requests(back, **options).select("vtime", "clock_time", "obj_id", "obj_size", "next_access_vtime")


def _source(spark: SparkSession, sf_dir: str, layout: str, text: bool = False) -> str:
    """The folder of the events with next accesses, written through the data source."""
    path = shared_dir(spark, "source")
    trace_source.write_trace(prep.oracle_annotate(trace_from_events(spark, sf_dir)), path, layout, text=text)
    return path


def _source_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_source.read_trace_source(spark, _source(spark, sf_dir, "lcs")).select("vtime", "clock_time", "obj_id", "obj_size", "next_access_vtime")


def _source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the middle third of a written trace: records before and behind it are not read."""
    path = _source(spark, sf_dir, "oracleGeneral")
    n = sum(p["n_req"] for p in trace_source.trace_list(path)["pieces"])
    return trace_source.read_trace_source(spark, path, ["vtime", "obj_id"]).filter((F.col("vtime") > n // 3) & (F.col("vtime") <= 2 * n // 3))


def _source_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header of a self-describing trace says, beside sums over what is read back."""
    path = _source(spark, sf_dir, "lcs")
    says = trace_source.header_statistics(path)
    read = trace_source.read_trace_source(spark, path, ["obj_size"]).agg(F.count("*").alias("n_read"), F.sum("obj_size").alias("n_read_byte"))
    return read.select(*[F.lit(says[c]).cast("long").alias(c) for c in trace_source.STATISTICS], "n_read", "n_read_byte")


def _interval(t: DataFrame, pixels: int) -> int:
    """Requests in an interval of a picture that is so many intervals wide, whatever the trace."""
    return max(1, -(-(t.agg(F.max("vtime")).first()[0] or 0) // pixels))


def _byte_sizes(t: DataFrame) -> list[int]:
    """Caches of some parts of the working set, and one that is smaller than some objects."""
    return parse_sizes("0.01,0.05,0.1,0.2,0.4,0.8,40", prep.working_set(t).first()["wss_byte"] or 0)


def _byte_misses(t: DataFrame, overhead: int) -> DataFrame:
    sizes = _byte_sizes(t)
    return weighted.byte_misses(weighted.byte_distances(t, sizes, overhead), sizes)


def _byte_residencies(t: DataFrame) -> DataFrame:
    return residency.residencies(residency.cached_byte_rows(t, BYTES, 16), BYTES)


def _shares(t: DataFrame) -> DataFrame:
    held = residency.residencies(residency.cached_rows(t, 100), 100)
    return residency.cache_shares(held, t.select("vtime", F.col("ns").alias("source")), t.agg(F.max("vtime")).first()[0] or 0, 1000)


def _warm(t: DataFrame) -> DataFrame:
    """The first fifth of the requests, and the first two days, warm the caches up."""
    rows = lru.distances_with_sizes(t).join(prep.timed(t).select("vtime", "t"), "vtime")
    return lru.lru_misses(lru.after_warmup(rows, (t.agg(F.max("vtime")).first()[0] or 0) // 5, 172800), SIZES)


def _bloom_first(t: DataFrame) -> DataFrame:
    """The filter has the size for all objects at an error of 5%."""
    return sketches.first_sightings(t, *sketches.filter_size(t.select("obj_id").distinct().count(), 0.05))


def _bloom_error(t: DataFrame) -> DataFrame:
    """Objects of the second half of the trace against a filter of the first half's: how many are in it, how many it may hold, and how many of these wrongly."""
    half = prep.scalar(t, F.floor(F.max("vtime") / 2))
    old, new = t.filter(F.col("vtime") <= half), t.filter(F.col("vtime") > half)
    held = old.select("obj_id").distinct()
    cells, hashes = sketches.filter_size(held.count(), 0.05)
    answers = sketches.asked(new, "obj_id", sketches.bloom_filter(old, "obj_id", cells, hashes), cells, hashes).join(held.withColumn("held", F.lit(True)), "obj_id", "left")
    return answers.agg(F.count("*").alias("n_asked"), F.count("held").alias("n_held"), F.count_if("maybe").alias("n_maybe"), F.count_if(F.col("maybe") & F.col("held").isNull()).alias("n_false"))


def _frequencies(t: DataFrame, make: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """Two cells an object, three hashes: a small filter, whose errors show."""
    cells = 2 * t.select("obj_id").distinct().count() + 2
    return sketches.estimates_beside_counts(t, make(t, cells, 3), cells, 3)


def _sampled_wss(t: DataFrame) -> DataFrame:
    """Estimates from a tenth of the objects beside the exact values."""
    exact = prep.working_set(t)
    return sampled.sampled_working_set(t, 10).select("*", prep.scalar(exact, F.first("wss_obj")).alias("exact_obj"), prep.scalar(exact, F.first("wss_byte")).alias("exact_byte"))


def _sampled_curve(t: DataFrame) -> DataFrame:
    """The curve from a tenth of the objects beside the exact one."""
    exact = lru.lru_misses(lru.distances_with_sizes(t), [50, 100, 200, 400]).select("cache_size", F.col("miss_ratio").alias("exact"))
    return sampled.sampled_curve(t, [50, 100, 200, 400], 10).join(exact, "cache_size")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in a folder for each tenant, read back."""
    folder = shared_dir(spark, "tenants")
    formats.split_by(trace_from_events(spark, sf_dir), folder, "ns")
    return spark.read.parquet(folder).select("ns", "vtime", "obj_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    facts = ["vtime", "obj_id", "t", "compulsory_miss", "vtime_since_last", "rtime_since_last", "create_rtime", "prev_size", "overwrite", "first_seen_in_window"]
    return {
        "annotate": _annotated("events", lambda a: a.select(*facts)),
        "oracle_annotate": _on("events", lambda t: prep.oracle_annotate(t).select("vtime", "clock_time", "obj_id", "obj_size", "next_access_vtime")),
        "write_aware_next": _on("events", prep.write_aware_next),
        "orders_trace": _on("orders", lambda t: t.select("vtime", "clock_time", "obj_id", "obj_size")),
        "trace_stat": _timed("events", an.trace_stat),
        "x_hit": _timed("skew", an.x_hit),
        "top_popular": _timed("skew", an.top_popular),
        "op_stat": _annotated("events", an.op_stat),
        "op_rollup": _timed("events", an.op_rollup),
        "req_rate": _annotated("events", an.req_rate),
        "req_rate_shifted": _timed("events", an.req_rate_shifted),
        "req_rate_summary": _annotated("events", an.req_rate_summary),
        "size_dist": _annotated("events", an.size_dist),
        "size_heatmap": _annotated("events", an.size_heatmap),
        "reuse_rt": _annotated("events", an.reuse_rt),
        "reuse_vt": _annotated("events", an.reuse_vt),
        "reuse_heatmap": _annotated("events", an.reuse_heatmap),
        "access_pattern": _annotated("events", an.access_pattern),
        "popularity": _timed("skew", an.popularity),
        "zipf_alpha": _timed("skew", an.zipf),
        "zipf_fit": _timed("orders", an.zipf),
        "popularity_decay": _annotated("events", an.popularity_decay),
        "popularity_decay_norm": _annotated("skew", an.popularity_decay_norm),
        "ttl_dist": _timed("events", an.ttl_dist),
        "lifetime": _annotated("events", an.lifetime),
        "prob_at_age": _annotated("events", an.prob_at_age),
        "create_future_reuse": _annotated("skew", an.create_future_reuse),
        "size_change": _annotated("events", an.size_change),
        "size_change_fine": _annotated("events", an.size_change_fine),
        "write_reuse": _annotated("events", an.write_reuse),
        "write_future_reuse": _timed("skew", an.write_future_reuse),
        "req_rate_trimmed": _annotated("events", lambda a: an.trimmed(an.req_rate(a), "n_req", "win", 2, 1)),
        "hist_cdf": _timed("skew", lambda a: an.cdf(an.popularity(a), "freq", "n_obj")),
        "one_hit_ratio": _annotated("skew", an.one_hit_ratio),
        "obj_reuse_stat": _timed("events", an.obj_reuse_stat),
        "group_compare": _timed("skew", an.group_compare),
        "dist_last_access": _on("events", lambda t: di.access_distances(t).select("vtime", "dist_last")),
        "dist_first_access": _on("events", lambda t: di.access_distances(t).select("vtime", "dist_first")),
        "dist_cnt": _on("skew", lambda t: di.access_distances(t).groupBy(F.col("dist_last").alias("dist")).agg(F.count("*").alias("cnt"))),
        "stack_dist": _on("skew", lambda t: di.stack_distances(t).select("vtime", "obj_id", "stack_dist")),
        "future_stack_dist": _on("skew", di.future_stack_distances),
        "lru_mrc": _on("events", di.lru_curve),
        "lru_mrc_orders": _on("orders", di.lru_curve),
        "heatmap_stack_dist": _on("skew", lambda t: an.interval_heatmap(di.stack_distances(t), "stack_dist", 1000)),
        "heatmap_hit_ratio_window": _on("skew", lambda t: an.heatmap_hit_ratio_window(di.stack_distances(t), 100, _interval(t, 10))),
        "heatmap_hit_ratio_size": _on("skew", lambda t: an.heatmap_hit_ratio_size(di.stack_distances(t), 200, 20, _interval(t, 10))),
        "heatmap_reuse_time": _annotated("events", lambda a: an.interval_heatmap(a, "rtime_since_last", 1000)),
        "wss": _on("events", prep.working_set),
        "sample_spatial": _on("events", lambda t: prep.sample_spatial(t, 10, hashed=False).select("vtime", "obj_id")),
        "sample_temporal": _on("events", lambda t: prep.sample_temporal(t, 10).select("vtime", "obj_id")),
        "first_last": _on("events", lambda t: t.agg(F.min_by("obj_id", "vtime").alias("first_obj"), F.max_by("obj_id", "vtime").alias("last_obj"), F.count("*").alias("n_req"))),
        "seek_half": _on("events", lambda t: t.filter(F.col("vtime") > prep.scalar(t, F.floor(F.max("vtime") / 2))).select("vtime", "obj_id")),
        "sim_lru": _on("events", lambda t: lru.lru_misses(lru.distances_with_sizes(t), SIZES)),
        "adm_size": _on("skew", lambda t: lru.lru_misses(lru.admitted_distances(t, "obj_size < 100"), SIZES)),
        "adm_second": _on("skew", lambda t: lru.lru_misses(lru.second_sightings(t), SIZES)),
        "lru_warmup": _on("skew", _warm),
        "lru_mrc_bytes": _on("skew", lambda t: _byte_misses(t, 0)),
        "lru_mrc_bytes_overhead": _on("skew", lambda t: _byte_misses(t, 16)),
        "lru_residencies": _on("skew", lambda t: residency.residencies(residency.cached_rows(t, 100), 100).drop("room")),
        "lru_residencies_bytes": _on("skew", _byte_residencies),
        "eviction_statistics": _on("skew", lambda t: residency.eviction_statistics(residency.residencies(residency.cached_rows(t, 100), 100))),
        "cache_shares": _on("skew", _shares),
        "lru_ttl": _on("skew", lambda t: residency.expiring_misses(t.withColumn("ttl", F.col("ttl") * 60), SIZES)),
        "prefetch_graph": _on("skew", association.probability_graph),
        "associations": _on("skew", association.associations),
        "bloom_first_sightings": _on("skew", _bloom_first),
        "bloom_error": _on("skew", _bloom_error),
        "frequency_sketch": _on("skew", lambda t: _frequencies(t, lambda t, cells, hashes: sketches.counting_filter(t, "obj_id", cells, hashes))),
        "frequency_sketch_minimal": _on("skew", lambda t: _frequencies(t, sketches.minimal_filter)),
        "wss_sampled": _on("skew", _sampled_wss),
        "lru_mrc_sampled": _on("skew", _sampled_curve),
        "interval_report": _on("skew", lambda t: lru.interval_report(di.stack_distances(t), 100, 1000)),
        "miss_trace": _on("skew", lambda t: lru.miss_trace(t, 100)),
        "topo_hierarchy": _on("skew", lambda t: topology.hierarchy(t, 16, 4)),
        "merge_traces": _on("events", lambda t: with_vtime(topology.merged(t.filter("ns < 4"), t.filter("ns >= 4")), "clock_time", "trace_no", "own_vtime").select("vtime", "trace_no", "own_vtime", "obj_id")),
        "trace_round_trip": _written_and_read,
        "trace_skip_limit": lambda spark, sf_dir: _written_and_read(spark, sf_dir, skip=100, limit=9000, ignore_obj_size=True),
        "source_round_trip": _source_round_trip,
        "source_window": _source_window,
        "source_header": _source_header,
        "text_twin": lambda spark, sf_dir: trace_source.text_twin(spark, _source(spark, sf_dir, "oracleGeneral", text=True)),
        "trace_print": _on("events", lambda t: formats.printed(prep.oracle_annotate(t))),
        "split_tenants": _split,
        "topo_cluster": _on("skew", lambda t: topology.server_load(t, _servers(t))),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
