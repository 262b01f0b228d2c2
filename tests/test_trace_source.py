"""The data source against packed bytes, with limits, fewer columns, failed and repeated attempts."""

import glob
import struct

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from tracewell.sources import formats
from tracewell.sources import trace_source as ts

SCHEMA = "vtime bigint, clock_time bigint, obj_id bigint, obj_size bigint, next_access_vtime bigint"


def requests(n, big=False):
    return [(k + 1, k // 3, (2**63 - 1 if big and k == 4 else k % 7), 10 + k % 7, -1 if k + 7 >= n else k + 8) for k in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select(*SCHEMA.replace(" bigint", "").split(", ")).collect())


def test_round_trip(spark, tmp_path):
    t = spark.createDataFrame(requests(100, big=True), SCHEMA)
    path = str(tmp_path / "out")
    ts.write_trace(t.orderBy(F.rand(1)), path, text=True)
    assert rows(ts.read_trace_source(spark, path, recordsPerRange=3)) == requests(100, big=True)
    whole = b"".join(open(f"{path}/{p['file']}", "rb").read() for p in ts.trace_list(path)["pieces"])
    assert whole == b"".join(struct.pack("<IQIq", *r[1:]) for r in requests(100, big=True))
    assert sorted(r["line"] for r in ts.text_twin(spark, path).collect()) == sorted(",".join(map(str, r[1:])) for r in requests(100, big=True))


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    first, more = spark.createDataFrame(requests(20), SCHEMA), spark.createDataFrame([(9, 50, 1, 2, -1)], SCHEMA)
    ts.write_trace(first, path)
    ts.write_trace(more, path, mode="append")
    assert rows(ts.read_trace_source(spark, path)) == [*requests(20), (21, 50, 1, 2, -1)]
    with pytest.raises(Exception):
        ts.write_trace(more, path, layout="standardIQI", mode="append")
    assert ts.read_trace_source(spark, path).count() == 21
    ts.write_trace(more, path)
    assert rows(ts.read_trace_source(spark, path)) == [(1, 50, 1, 2, -1)]
    assert len(glob.glob(f"{path}/data-*")) == 1 and len(glob.glob(f"{path}/_trace-*")) == 1


def test_failed_write_leaves_what_was(spark, tmp_path):
    path = str(tmp_path / "out")
    t = spark.createDataFrame(requests(20), SCHEMA)
    ts.write_trace(t, path)
    for bad in (t.withColumn("obj_id", F.when(F.col("vtime") != 15, F.col("obj_id"))), t.withColumn("obj_size", F.when(F.col("vtime") == 15, F.lit(1 << 32)).otherwise(1)), t.withColumn("vtime", F.greatest("vtime", F.lit(19)))):
        with pytest.raises(Exception):
            ts.write_trace(bad, path)
    with pytest.raises(Exception):
        t.repartition(3, "obj_id").sortWithinPartitions("vtime").write.format("trace").mode("append").save(path)
    assert rows(ts.read_trace_source(spark, path)) == requests(20)
    assert ts.remove_unlisted(path) == []
    ts.remove_unlisted(path, 0)
    assert rows(ts.read_trace_source(spark, path)) == requests(20) and len(glob.glob(f"{path}/data-*")) == 1


def test_only_committed_attempts_count(spark, tmp_path, monkeypatch):
    """Of two attempts of a task, one of them lost on its way, the list names the committed one."""
    import pyarrow as pa
    import pyspark

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    names = SCHEMA.replace(" bigint", "").split(", ")
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in requests(9)])
    w = ts.TraceWriter(str(tmp_path / "out"), "oracleGeneral", names, True, False, 0, 0)

    def lost():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        w.write(lost())
    w.write(iter([batch]))
    w.commit([w.write(iter([batch])), w.write(iter([]))])
    assert rows(ts.read_trace_source(spark, str(tmp_path / "out"))) == requests(9)


def test_limits_choose_records(spark, tmp_path):
    path = str(tmp_path / "t.oracleGeneral")
    open(path, "wb").write(b"".join(struct.pack("<IQIq", *r[1:]) for r in requests(1000)))
    asked = ts.TraceReader(path, "auto", ["obj_id"], 100)
    other = EqualTo(("obj_id",), 5)
    assert list(asked.pushFilters([GreaterThan(("vtime",), 150), LessThanOrEqual(("vtime",), 420), other, IsNotNull(("vtime",))])) == [other]
    assert [(p.base + 1, p.n) for p in asked.partitions()] == [(151, 100), (251, 100), (351, 70)]
    few = In(("vtime",), (300, 200))
    assert list(asked.pushFilters([few])) == [few] and [(p.base + 1, p.n) for p in asked.partitions()] == [(200, 100), (300, 1)]
    df = ts.read_trace_source(spark, path, ["obj_id", "vtime"], recordsPerRange=64).filter("vtime >= 100 and vtime < 300 and obj_id = 3")
    assert df.columns == ["obj_id", "vtime"] and sorted(r["vtime"] for r in df.collect()) == [r[0] for r in requests(1000) if 100 <= r[0] < 300 and r[2] == 3]
    none = ts.read_trace_source(spark, path).filter("vtime > 1000")
    assert none.count() == 0 and ts.read_trace_source(spark, path).filter("vtime is null").count() == 0
    assert ts.read_trace_source(spark, path).filter("vtime in (3, 8) or vtime = 10").count() == 3
    with pytest.raises(Exception):
        ts.read_trace_source(spark, path, ["no_such"]).count()


@pytest.mark.parametrize("layout", sorted(formats.LAYOUTS))
def test_every_layout(spark, tmp_path, layout):
    fields = formats.LAYOUTS[layout]
    names = [c for c, _ in fields]
    made = [(r + 1, *(10 * r + k + 1 for k in range(len(fields)))) for r in range(9)]
    t = spark.createDataFrame(made, "vtime bigint, " + ", ".join(f"{c} bigint" for c in names))
    ts.write_trace(t, str(tmp_path / "out"), layout)
    assert sorted(tuple(r) for r in ts.read_trace_source(spark, str(tmp_path / "out")).select("vtime", *names).collect()) == made
    if layout.startswith("vscsi"):
        return
    single = b"".join(open(f"{tmp_path}/out/{p['file']}", "rb").read() for p in ts.trace_list(str(tmp_path / "out"))["pieces"])
    (tmp_path / "one.bin.zst").write_bytes(zstandard.ZstdCompressor().compress(single))
    packed = ts.read_trace_source(spark, str(tmp_path / "one.bin.zst"), layout=layout)
    assert sorted(tuple(r) for r in packed.filter("vtime > 2 and vtime < 6").select("vtime", *names).collect()) == made[2:5]


def test_self_describing(spark, tmp_path):
    path = str(tmp_path / "out")
    ts.write_trace(spark.createDataFrame(requests(30), SCHEMA), path, "lcs")
    listed = ts.trace_list(path)
    one = b"".join(open(f"{path}/{f}", "rb").read() for f in [listed["header"], *(p["file"] for p in listed["pieces"])])
    (tmp_path / "one.lcs").write_bytes(one)
    assert ts.lcs_statistics(one[:1024]) == {"n_req": 30, "n_obj": 7, "n_req_byte": sum(r[3] for r in requests(30)), "n_obj_byte": sum(range(10, 17))}
    for df in (ts.read_trace_source(spark, path), ts.read_trace_source(spark, str(tmp_path / "one.lcs"), layout="lcs")):
        assert rows(df) == requests(30)
    assert formats.read_trace(spark, str(tmp_path / "one.lcs"), "lcs").count() == 30
    with pytest.raises(ValueError):
        ts.write_trace(spark.createDataFrame(requests(3), SCHEMA), path, "lcs", "append")


def test_empty(spark, tmp_path):
    ts.write_trace(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"), text=True)
    assert ts.read_trace_source(spark, str(tmp_path / "out")).count() == 0 and ts.text_twin(spark, str(tmp_path / "out")).count() == 0
    ts.write_trace(spark.createDataFrame([], SCHEMA), str(tmp_path / "lcs"), "lcs")
    assert ts.read_trace_source(spark, str(tmp_path / "lcs")).count() == 0
