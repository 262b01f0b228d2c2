"""Streaming versions agree with the batch ones."""

from pyspark.sql import functions as F

from tracewell.sources.tables import trace_from_events
from tracewell.streaming.rates import request_rates, reuse_times


def as_stream(spark, sf_dir, folder):
    t = trace_from_events(spark, sf_dir).select(F.timestamp_seconds("clock_time").alias("ts"), "obj_id", "obj_size")
    t.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(folder)
    return t, spark.readStream.schema(t.schema).parquet(folder)


def test_rates(spark, sf_dir, tmp_path):
    batch, stream = as_stream(spark, sf_dir, str(tmp_path / "in"))
    q = request_rates(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.window("ts", "1 day")["start"].alias("start")).agg(F.count("*").alias("n_req"), F.sum("obj_size").alias("bytes"))
    assert spark.table("rates").select("start", "n_req", "bytes").exceptAll(want).count() == 0
    assert spark.table("rates").count() == want.count()


def test_reuse(spark, sf_dir, tmp_path):
    batch, stream = as_stream(spark, sf_dir, str(tmp_path / "in"))
    q = reuse_times(stream).writeStream.outputMode("append").format("memory").queryName("reuse").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("reuse")
    assert got.count() == batch.count()
    assert got.filter("since_last is null").count() == batch.select("obj_id").distinct().count()
    span = batch.groupBy("obj_id").agg((F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("s")).agg(F.sum("s")).first()[0]
    assert got.agg(F.sum("since_last")).first()[0] == span
