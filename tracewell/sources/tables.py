"""Traces from tables, and a dense order for tables that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: The operation that each kind of event stands for.
EVENT_OPS = {"view": "get", "click": "gets", "purchase": "set", "signup": "add", "error": "delete"}


def with_vtime(rows: DataFrame, *order: str) -> DataFrame:
    """Adds vtime = 1, 2, ... in the given order. Rows are range-partitioned and sorted; each partition starts where the ones before end, so no task sees all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("part", (F.sum("n").over(before) - F.col("n")).alias("start"))
    # One row for each partition of the sort.
    joined = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("vtime", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "start", "place")


def trace_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: event_id is dense and in order of time, so vtime is event_id + 1."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    op = F.lit("invalid")
    for name, to in EVENT_OPS.items():
        op = F.when(F.col("event_type") == name, to).otherwise(op)
    return e.select(
        (F.col("event_id") + 1).alias("vtime"), F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).alias("clock_time"), F.col("user_id").alias("obj_id"),
        F.greatest(F.lit(1).cast("long"), F.floor("value")).alias("obj_size"), op.alias("op"), (60 * k).cast("int").alias("ttl"), (k % 8).cast("int").alias("ns"),
    )


def skewed_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with object ids that a few objects dominate."""
    base = trace_from_events(spark, sf_dir)
    skew = (F.col("obj_id") * 100 + F.floor(F.col("ttl") / 60)) % (1 + ((F.col("vtime") - 1) * 7919) % 1000)
    return base.withColumn("obj_id", skew)


def trace_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as requests of customers, in order of date and key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(
        "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("clock_time"), F.col("o_custkey").alias("obj_id"),
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("o_totalprice") / 1000)).alias("obj_size"), F.lit("get").alias("op"), F.lit(None).cast("int").alias("ttl"), F.lit(0).alias("ns"),
    )
    ordered = with_vtime(rows, "clock_time", "o_orderkey")
    return ordered.select("vtime", "clock_time", "obj_id", "obj_size", "op", "ttl", "ns")
