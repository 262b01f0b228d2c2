"""Files and tables as traces."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import analytics, distance, lru, prep, topology
from tracewell.schema import parse_params, parse_sizes
from tracewell.sources import formats, tables

CODES = formats.WIDTHS


@pytest.mark.parametrize("layout", sorted(formats.LAYOUTS))
def test_binary_layouts(spark, tmp_path, layout):
    fields = formats.LAYOUTS[layout]
    fmt = "<" + "".join(c for _, c in fields)
    rows = [tuple(10 * r + k + 1 for k in range(len(fields))) for r in range(5)]
    if ("obj_id", "Q") in fields:
        big = list(rows[4])
        big[fields.index(("obj_id", "Q"))] = 2**63 + 5
        rows[4] = tuple(big)
    (tmp_path / "t.bin").write_bytes(b"".join(struct.pack(fmt, *r) for r in rows))
    got = formats.read_binary(spark, str(tmp_path / "t.bin"), layout, records_per_range=2).orderBy("vtime").collect()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert [tuple(r[c] for c, _ in fields) for r in got] == [tuple(map(signed, r)) for r in rows]
    assert [r["vtime"] for r in got] == [1, 2, 3, 4, 5]
    assert formats.as_requests(formats.read_binary(spark, str(tmp_path / "t.bin"), layout)).count() == 5


def test_wrong_length(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"x" * 25)
    with pytest.raises(ValueError):
        formats.read_binary(spark, str(tmp_path / "t.bin"), "oracleGeneral")
    with pytest.raises(ValueError):
        formats.layout_of("<II", ["a"])


def lcs_header(fmt, fields, n=None, magic=formats.LCS_MAGIC, width=None):
    numbers = [fields.get(name, 0) for name in formats.LCS_FIELDS]
    return formats.LCS_HEADER.pack(magic, ("<" + fmt).encode(), *numbers, len(fmt) if n is None else n, struct.calcsize("<" + fmt) if width is None else width, 1, magic)


def test_self_describing_files(spark, tmp_path):
    fields = {"clock_time": 1, "obj_id": 2, "obj_size": 3, "ns": 4}
    assert formats.LCS_HEADER.size == 1024
    (tmp_path / "t.lcs").write_bytes(lcs_header("IQIHB", fields) + b"".join(struct.pack("<IQIHB", 5 * k, 2**63 + k, k, 7, 9) for k in range(4)))
    got = formats.read_trace(spark, str(tmp_path / "t.lcs"), "lcs").orderBy("vtime").collect()
    assert [(r["vtime"], r["clock_time"], r["obj_id"], r["obj_size"], r["ns"]) for r in got] == [(k + 1, 5 * k, k - 2**63, k, 7) for k in (1, 2, 3)]
    for bad in (lcs_header("IQI", fields, magic=1), lcs_header("IQI", fields, n=4), lcs_header("IQI", fields, width=15), lcs_header("IQI", {"obj_id": 9})):
        with pytest.raises(ValueError):
            formats.lcs_layout(bad)


def test_names_and_versions(spark, tmp_path):
    for name, layout in [("a/w.oracleGeneral.zst", "oracleGeneral"), ("x.ORACLEGENERAL", "oracleGeneral"), ("t.vscsi", "vscsi"), ("b.oracleGeneralOpNS", "oracleGeneralOpNS"), ("c.twr.sbin", "twr"), ("oracleWiki19u.x", "oracleWiki19u")]:
        assert formats.layout_by_name(name) == layout
    with pytest.raises(ValueError):
        formats.layout_by_name("trace.csv")
    v1, v2 = struct.pack("<IIIHHQQ", 1, 512, 0, 42, 1 << 8, 77, 3_000_000), struct.pack("<HHIIIQQQ", 42, 2 << 8, 1, 512, 0, 78, 4_000_000, 0)
    for data, want in ((v1, (77, 512, 3)), (v2, (78, 512, 4))):
        (tmp_path / "t.vscsi").write_bytes(data * 3)
        assert [(r["obj_id"], r["obj_size"], r["clock_time"]) for r in formats.read_trace(spark, str(tmp_path / "t.vscsi")).collect()] == [want] * 3
    with pytest.raises(ValueError):
        formats.vscsi_version(b"\0" * 16)


def test_zstd_and_options(spark, tmp_path):
    import zstandard

    data = b"".join(struct.pack("<IQIhhhq", k, k % 9, k % 5, 4, 5, 6, -1) for k in range(150_000))
    pack = zstandard.ZstdCompressor()
    (tmp_path / "t.oracleAkamai.zst").write_bytes(pack.compress(data[: 30 * 70_001 + 7]) + pack.compress(data[30 * 70_001 + 7 :]))
    got = formats.read_trace(spark, str(tmp_path / "t.oracleAkamai.zst"))
    assert got.count() == 120_000 and got.agg(F.max("vtime")).first()[0] == 150_000
    part = formats.read_trace(spark, str(tmp_path / "t.oracleAkamai.zst"), skip=10, limit=20, ignore_obj_size=True).orderBy("vtime").collect()
    assert [(r["vtime"], r["clock_time"], r["obj_size"]) for r in part] == [(k - 9, k, 1) for k in range(10, 30)]
    (tmp_path / "bad.oracleAkamai.zst").write_bytes(pack.compress(data[:100]))
    with pytest.raises(Exception):
        formats.read_trace(spark, str(tmp_path / "bad.oracleAkamai.zst"))


def test_write_and_read_back(spark, tmp_path, sf_dir):
    t = prep.oracle_annotate(tables.trace_from_events(spark, sf_dir))
    parts = formats.write_binary(t, str(tmp_path / "out")).orderBy("part").collect()
    data = b"".join(open(r["path"], "rb").read() for r in parts)
    (tmp_path / "all.bin").write_bytes(data)
    back = formats.read_binary(spark, str(tmp_path / "all.bin"), "oracleGeneral")
    want = t.select("vtime", "clock_time", "obj_id", "obj_size", "next_access_vtime")
    assert back.select(*want.columns).exceptAll(want).count() == 0 and back.count() == want.count()


def test_text(spark, tmp_path):
    assert formats.sniff_csv("time,id,size") == (",", True) and formats.sniff_csv("1\t2\t3") == ("\t", False) and formats.sniff_csv("12|34") == ("|", False)
    with pytest.raises(ValueError):
        formats.sniff_csv("12 34")
    (tmp_path / "a.csv").write_text("time,id,size,cnt\n1,7,10,2\n2,8,0,1\n3,7,10,1\n")
    got = formats.read_csv(spark, str(tmp_path / "a.csv"), 1, 2, 3, 4)
    assert sorted(r["obj_id"] for r in got.collect()) == [7, 7, 7]
    assert [r["vtime"] for r in tables.with_vtime(got, "line", "k").orderBy("vtime").collect()] == [1, 2, 3]
    (tmp_path / "a.txt").write_text("5\n\n6\n5\n")
    assert sorted(r["obj_id"] for r in formats.read_ids(spark, str(tmp_path / "a.txt")).collect()) == [5, 5, 6]


def test_grammars():
    assert parse_sizes("1KB,2gib,100", 0) == [1024, 2 << 30, 100]
    assert parse_sizes("0.5,1KB", 1000) == [500, 1024] and parse_sizes("0.5,0.1", 1000) == [500, 100] and len(parse_sizes("auto", 10**6)) == 8
    assert parse_params("n_seg=4;Ratio=0.1") == {"n-seg": "4", "ratio": "0.1"}
    with pytest.raises(ValueError):
        parse_sizes("ten", 1)


def made_trace(spark, ids):
    return spark.createDataFrame([(i + 1, i // 3, int(k), 1, "get", None, 0) for i, k in enumerate(ids)], "vtime bigint, clock_time bigint, obj_id bigint, obj_size bigint, op string, ttl int, ns int")


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_stack_distance(spark, block):
    ids = np.random.default_rng(1).zipf(1.3, 400) % 50
    stack, want = [], []
    for k in ids:
        want.append(stack.index(k) if k in stack else -1)
        if k in stack:
            stack.remove(k)
        stack.insert(0, k)
    got = distance.stack_distances(made_trace(spark, ids), block).orderBy("vtime").collect()
    assert [r["stack_dist"] for r in got] == want


def test_neighbours_across_slices(spark):
    ids = [1, 2, 1, 1, 3, 2, 1] * 5
    a = prep.with_neighbours(made_trace(spark, ids), slice_len=4).collect()
    b = prep.with_neighbours(made_trace(spark, ids)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_ring(spark):
    servers = spark.createDataFrame([(f"s{k}",) for k in range(5)], "server string")
    arcs = topology.ring(servers).collect()
    assert sum(r["high"] - r["low"] + 1 for r in arcs) == topology.RING
    t = made_trace(spark, range(2000))
    before = {r["obj_id"]: r["server"] for r in topology.routed(t, servers).collect()}
    after = {r["obj_id"]: r["server"] for r in topology.routed(t, servers.filter("server <> 's3'")).collect()}
    assert len(before) == 2000 and set(before.values()) == {f"s{k}" for k in range(5)}
    assert all(after[k] == s for k, s in before.items() if s != "s3")


def test_replicas(spark):
    servers = spark.createDataFrame([(f"s{k}",) for k in range(5)], "server string")
    t = made_trace(spark, range(300))
    one = {r["obj_id"]: r["server"] for r in topology.routed(t, servers).collect()}
    got = {}
    for r in topology.replicas(t, servers, 3, points=20).collect():
        got.setdefault(r["obj_id"], {})[r["replica"]] = r["server"]
    assert len(got) == 300 and all(sorted(v) == [1, 2, 3] and len(set(v.values())) == 3 for v in got.values())
    first = {r["obj_id"]: r["server"] for r in topology.replicas(t, servers, 9).filter("replica = 1").collect()}
    assert first == one


def lru_list(keys, size):
    held, hits = [], []
    for k in keys:
        hits.append(k in held)
        if k in held:
            held.remove(k)
        held = [*held, k][-size:]
    return hits


def test_lru_against_lists(spark):
    keys = [int(k) for k in np.random.default_rng(3).zipf(1.3, 500) % 40]
    t = made_trace(spark, keys)
    for r in lru.lru_misses(lru.distances_with_sizes(t), [1, 5, 20]).collect():
        assert r["n_miss"] == lru_list(keys, r["cache_size"]).count(False) and r["n_req"] == 500
    passed = [r["vtime"] for r in lru.miss_trace(t, 5).orderBy("vtime").collect()]
    assert passed == [i + 1 for i, h in enumerate(lru_list(keys, 5)) if not h]
    shards = [[(i, k) for i, k in enumerate(keys) if k % 3 == s] for s in range(3)]
    want = sorted(x[0] + 1 for s in shards for x, h in zip(s, lru_list([k for _, k in s], 4), strict=True) if not h)
    assert [r["vtime"] for r in lru.sharded_miss_trace(t, 4, 3).orderBy("vtime").collect()] == want


def test_slices_do_not_matter(spark, monkeypatch, sf_dir):
    a = prep.annotate(tables.trace_from_events(spark, sf_dir))
    want = [sorted(map(str, f(a).collect())) for f in (analytics.create_future_reuse, analytics.write_reuse)]
    monkeypatch.setattr(analytics, "SLICE", 7)
    monkeypatch.setattr(analytics, "RANKS", 3)
    assert [sorted(map(str, f(a).collect())) for f in (analytics.create_future_reuse, analytics.write_reuse)] == want


def test_printed_and_split(spark, tmp_path):
    t = made_trace(spark, [5, 2**33 + 7])
    assert [r["line"] for r in formats.printed(t).orderBy("vtime").collect()] == ["0,5,1", f"0,{2**33 + 7},1"]
    assert [r["line"] for r in formats.printed(t, "ids32").orderBy("vtime").collect()] == ["5", "7"]
    formats.split_by(t.withColumn("ns", F.col("vtime")), str(tmp_path / "out"), "ns")
    assert spark.read.parquet(str(tmp_path / "out" / "ns=2")).count() == 1


def test_empty_trace(spark):
    t = made_trace(spark, [])
    assert distance.stack_distances(t).count() == 0 and prep.annotate(t).count() == 0
    assert tables.with_vtime(t.drop("vtime"), "clock_time").count() == 0
    assert t.select(F.count("*")).first()[0] == 0
