"""Reading traces from files: delimited text, id lists, and packed binary records; and writing them.

Binary layouts are lists of (name, struct code), little-endian without padding. Files are cut at record boundaries into ranges;
each task reads its own range, so one large file is read by many tasks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Fixed record layouts: field and code (b B h H i I l L q Q f d, sizes as in packed C structs).
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "oracleGeneral": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("next_access_vtime", "q")],
    "oracleGeneralOpNS": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("op", "B"), ("ns", "H"), ("next_access_vtime", "q")],
    "vscsi1": [("sn", "I"), ("obj_size", "I"), ("n_sg", "I"), ("cmd", "H"), ("ver", "H"), ("obj_id", "Q"), ("ts", "Q")],
    "vscsi2": [("cmd", "H"), ("ver", "H"), ("sn", "I"), ("obj_size", "I"), ("n_sg", "I"), ("obj_id", "Q"), ("ts", "Q"), ("rt", "Q")],
    "twr": [("clock_time", "I"), ("obj_id", "Q"), ("key_val", "I"), ("op_ttl", "I")],
    "twrNS": [("clock_time", "I"), ("obj_id", "Q"), ("key_val", "I"), ("op_ttl", "I"), ("ns", "H")],
    "akamai": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("tenant_id", "H"), ("bucket_id", "H"), ("content_type", "H")],
    "wiki16u": [("obj_id", "Q"), ("obj_size", "I"), ("content_type", "H")],
    "wiki19u": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("content_type", "H")],
    "wiki19t": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I")],
    "standardIQQ": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "Q")],
    "standardIQI": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I")],
    "standardIII": [("clock_time", "I"), ("obj_id", "I"), ("obj_size", "I")],
    "standardIQIBH": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("op", "B"), ("ns", "H")],
    "valpin": [("obj_id", "Q")],
    "cf1": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "Q"), ("ttl", "i"), ("age", "I"), ("hostname", "I"), ("content_type", "H"), ("extension", "H"), ("n_level", "H"), ("n_param", "B"), ("method", "B"), ("colo", "B")],
    "oracleCF1": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "Q"), ("ttl", "i"), ("age", "I"), ("hostname", "I"), ("next_access_vtime", "q"), ("content_type", "H"), ("extension", "H"), ("n_level", "H"), ("n_param", "B"), ("method", "B"), ("colo", "B")],
    "oracleAkamai": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("tenant_id", "h"), ("bucket_id", "h"), ("content_type", "h"), ("next_access_vtime", "q")],
    "oracleWiki16u": [("obj_id", "Q"), ("obj_size", "I"), ("content_type", "H"), ("next_access_vtime", "q")],
    "oracleWiki19u": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("content_type", "H"), ("next_access_vtime", "q")],
    "oracleSimTwr": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("ttl", "I"), ("next_access_vtime", "q")],
    "oracleSimTwrNS": [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("ttl", "i"), ("ns", "H"), ("next_access_vtime", "q")],
    "oracleSysTwr": [("clock_time", "I"), ("obj_id", "Q"), ("key_size", "H"), ("val_size", "I"), ("op", "H"), ("ns", "H"), ("ttl", "i"), ("next_access_vtime", "q")],
    "oracleSysTwrNS": [("clock_time", "I"), ("obj_id", "Q"), ("key_size", "H"), ("val_size", "I"), ("op", "H"), ("ns", "H"), ("ttl", "i"), ("next_access_vtime", "q")],
}
#: Fixed parts of file names (in any case) and the layout each stands for; the first that fits counts.
NAMES = [
    ("oracleGeneralBin", "oracleGeneral"), ("bin.oracleGeneral", "oracleGeneral"), ("oracleGeneral.", "oracleGeneral"), (".vscsi", "vscsi"), ("oracleGeneralOpNS", "oracleGeneralOpNS"),
    ("oracleCF1", "oracleCF1"), ("oracleAkamai", "oracleAkamai"), ("oracleWiki16u", "oracleWiki16u"), ("oracleWiki19u", "oracleWiki19u"), (".twr.", "twr"), (".twrNS.", "twrNS"), ("oracleSysTwrNS", "oracleSysTwrNS"),
]
#: Fields of this layout that are stored with 1 added.
PLUS_ONE = {"oracleAkamai": ("tenant_id", "bucket_id", "content_type")}
#: Bytes of each code.
WIDTHS = {"b": 1, "B": 1, "c": 1, "h": 2, "H": 2, "i": 4, "I": 4, "l": 4, "L": 4, "q": 8, "Q": 8, "f": 4, "d": 8}
#: Fixed header of files that describe themselves: magic, format, numbers of the fields (object, size, time, last and next access, operation, TTL, tenant, content type), statistics, fields, record size, version, magic.
LCS_HEADER, LCS_MAGIC = struct.Struct("<Q240s9B231x512xIIQQ"), 0x123456789ABCDEF0
LCS_FIELDS = ["obj_id", "obj_size", "clock_time", "last_access_vtime", "next_access_vtime", "op", "ttl", "ns", "content_type"]
NUMPY = {"b": "i1", "B": "u1", "c": "u1", "h": "<i2", "H": "<u2", "i": "<i4", "I": "<u4", "l": "<i4", "L": "<u4", "q": "<i8", "Q": "<u8", "f": "<f4", "d": "<f8"}


def layout_of(fmt: str, names: list[str]) -> list[tuple[str, str]]:
    """A layout from a struct-style format such as "<IQIq" and its fields' names."""
    codes = [c for c in fmt if c not in "<>=!@ "]
    if len(codes) != len(names):
        raise ValueError(f"{len(names)} names for {len(codes)} fields")
    return list(zip(names, codes, strict=True))


def _dtype(layout: list[tuple[str, str]]) -> np.dtype:
    return np.dtype([(n, NUMPY[c]) for n, c in layout])


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)


def read_binary(spark: SparkSession, path: str, layout: list[tuple[str, str]] | str, header: int = 0, records_per_range: int = 1 << 20) -> DataFrame:
    """All fields of a file of packed records as longs, with vtime. Ids keep their 64 bits."""
    fields = LAYOUTS[layout] if isinstance(layout, str) else layout
    kind = _dtype(fields)
    fs, at = _fs(path)
    size = fs.get_file_info(at).size - header
    if size % kind.itemsize:
        raise ValueError(f"{path}: {size} bytes are no whole number of records of {kind.itemsize}")
    total, step = size // kind.itemsize, records_per_range
    ranges = spark.range(0, max(1, -(-total // step)), 1, max(1, min(4096, -(-total // step))))
    schema = "vtime bigint, " + ", ".join(f"{n} bigint" for n, _ in fields)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for k in f.column("id").to_pylist():
                n = min(step, total - k * step)
                if n <= 0:
                    continue
                fs, at = _fs(path)
                with fs.open_input_file(at) as file:
                    rows = np.frombuffer(file.read_at(n * kind.itemsize, header + k * step * kind.itemsize), kind)
                yield _as_batch(rows, fields, k * step)

    return ranges.mapInArrow(load, schema)


def layout_by_name(path: str) -> str:
    """The layout that a file's name stands for."""
    name = path.lower()
    for part, layout in NAMES:
        if part.lower() in name:
            return layout
    if name.endswith("oraclegeneral"):
        return "oracleGeneral"
    raise ValueError(f"{path}: no known layout in the name")


def lcs_layout(head: bytes) -> list[tuple[str, str]]:
    """The layout in a self-describing file's header; what is wrong with it raises."""
    start, fmt, *fields, n, width, _, end = LCS_HEADER.unpack(head)
    codes = fmt.split(b"\0")[0].decode("ascii")[1:]
    if start != LCS_MAGIC or end != LCS_MAGIC:
        raise ValueError("the header has no magic number")
    if n != len(codes) or not 1 <= fields[0] <= n:
        raise ValueError(f"{n} fields, object field {fields[0]}, but format {codes}")
    if sum(WIDTHS[c] for c in codes) != width:
        raise ValueError(f"records of {width} bytes, but format {codes}")
    names = {k: name for name, k in zip(LCS_FIELDS, fields, strict=True) if k}
    return [(names.get(k + 1, f"field_{k + 1}"), c) for k, c in enumerate(codes)]


def _head(path: str, n: int) -> bytes:
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression=None) as raw:
        if not path.endswith(".zst"):
            return raw.read(n)
        with zstandard.ZstdDecompressor().stream_reader(raw) as unpacked:
            return unpacked.read(n)


def vscsi_version(head: bytes) -> str:
    """Which of the two record layouts, by the version in the upper byte of its field."""
    if int.from_bytes(head[2:4], "little") >> 8 == 2:
        return "vscsi2"
    if int.from_bytes(head[14:16], "little") >> 8 == 1:
        return "vscsi1"
    raise ValueError("neither version of the records")


def read_zstd(spark: SparkSession, path: str, fields: list[tuple[str, str]], header: int = 0) -> DataFrame:
    """As read_binary, from a zstandard file. Such a stream can only be read from its start: one task unpacks it, a bounded piece at a time, into a table that all others read."""
    kind = _dtype(fields)
    schema = "vtime bigint, " + ", ".join(f"{n} bigint" for n, _ in fields)

    def load(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(path)
        with fs.open_input_stream(at, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as unpacked:
            unpacked.read(header)
            left, n = b"", 0
            while block := unpacked.read(kind.itemsize << 16):
                block = left + block
                whole = len(block) // kind.itemsize * kind.itemsize
                left = block[whole:]
                rows = np.frombuffer(block[:whole], kind)
                yield _as_batch(rows, fields, n)
                n += len(rows)
            if left:
                raise ValueError(f"{path}: {len(left)} bytes are left after the last record")

    return stored(spark.range(0, 1, 1, 1).mapInArrow(load, schema), "unpacked")


def read_trace(spark: SparkSession, path: str, layout: str = "auto", **options) -> DataFrame:
    """Requests of a file of any binary layout, plain or zstandard (.zst); by its name where none is given. options: those of as_requests."""
    layout = layout_by_name(path) if layout == "auto" else layout
    header = 0
    if layout == "lcs":
        header, fields = LCS_HEADER.size, lcs_layout(_head(path, LCS_HEADER.size))
    else:
        fields = LAYOUTS[vscsi_version(_head(path, 16)) if layout == "vscsi" else layout]
    rows = read_zstd(spark, path, fields, header) if path.endswith(".zst") else read_binary(spark, path, fields, header)
    for c in PLUS_ONE.get(layout, ()):
        rows = rows.withColumn(c, F.col(c) - 1)
    return as_requests(rows, **options)


def read_parts(spark: SparkSession, parts: DataFrame, layout: str, records_per_range: int = 1 << 20) -> DataFrame:
    """The file whose parts write_binary wrote, as one trace. parts: its table. Ranges of records are dealt to tasks."""
    fields, kind = LAYOUTS[layout], _dtype(LAYOUTS[layout])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select("path", "n_req", (F.sum("n_req").over(before) - F.col("n_req")).alias("base"))
    ranges = placed.filter("n_req > 0").select("path", "n_req", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_req") - 1, F.lit(records_per_range))).alias("from"))
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = _fs(r["path"])
                n = min(records_per_range, r["n_req"] - r["from"])
                with fs.open_input_file(at) as file:
                    yield _as_batch(np.frombuffer(file.read_at(n * kind.itemsize, r["from"] * kind.itemsize), kind), fields, r["base"] + r["from"])

    return ranges.repartition(n_tasks, "path", "from").mapInArrow(load, "vtime bigint, " + ", ".join(f"{n} bigint" for n, _ in fields))


def _as_batch(rows: np.ndarray, fields: list[tuple[str, str]], before: int) -> pa.RecordBatch:
    cols = [pa.array(rows[c].astype(np.uint64).view(np.int64) if code == "Q" else rows[c].astype(np.int64)) for c, code in fields]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(before + 1, before + len(rows) + 1)), *cols], names=["vtime", *(c for c, _ in fields)])


def printed(trace: DataFrame, what: str = "all") -> DataFrame:
    """vtime, line: requests as text. all: time, object, size and, where it is known, next access; ids: objects; ids32: their lower 32 bits."""
    cols = ["clock_time", "obj_id", "obj_size"] + ["next_access_vtime"] * ("next_access_vtime" in trace.columns)
    line = {"all": F.concat_ws(",", *[F.col(c).cast("string") for c in cols]), "ids": F.col("obj_id").cast("string"), "ids32": F.col("obj_id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("string")}[what]
    return trace.select("vtime", line.alias("line"))


def split_by(trace: DataFrame, folder: str, column: str) -> None:
    """A folder of Parquet files for each value of a column. Rows are dealt by value and by place, so that a value with a third of all rows is written by many tasks."""
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trace.repartition(n, column, F.pmod(F.xxhash64("vtime"), F.lit(8))).write.partitionBy(column).parquet(folder)


def as_requests(rows: DataFrame, skip: int = 0, limit: int | None = None, ignore_obj_size: bool = False) -> DataFrame:
    """The fields that all traces have, from whatever a layout gives: packed sizes, operations and times are taken apart. skip and limit count records of the file, which are numbered from 1 after the skipped ones; with ignore_obj_size every size is 1. Requests of size 0 are left out."""
    if skip or limit is not None:
        rows = rows.filter((F.col("vtime") > skip) & (F.lit(True) if limit is None else F.col("vtime") <= skip + limit)).withColumn("vtime", F.col("vtime") - skip)
    have = set(rows.columns)
    long = lambda x: F.lit(x).cast("long")
    time = F.col("clock_time") if "clock_time" in have else F.floor(F.col("ts") / 1_000_000) if "ts" in have else long(0)
    size = F.col("obj_size") if "obj_size" in have else F.shiftright("key_val", 22) + F.col("key_val").bitwiseAND(long((1 << 22) - 1)) if "key_val" in have else F.col("key_size") + F.col("val_size") if "key_size" in have else long(1)
    size = long(1) if ignore_obj_size else size
    ttl = F.col("op_ttl").bitwiseAND(long((1 << 24) - 1)) if "op_ttl" in have else F.col("ttl") if "ttl" in have else F.lit(None)
    op = F.shiftright("op_ttl", 24) if "op_ttl" in have else F.col("op") if "op" in have else F.lit(None)
    ns = F.col("ns") if "ns" in have else F.lit(None)
    nxt = F.when(F.col("next_access_vtime").isin(-1, 2**63 - 1), -1).otherwise(F.col("next_access_vtime")) if "next_access_vtime" in have else F.lit(None)
    return rows.select("vtime", time.cast("long").alias("clock_time"), "obj_id", size.cast("long").alias("obj_size"), op.cast("int").alias("op_code"), ttl.cast("int").alias("ttl"), ns.cast("int").alias("ns"), nxt.cast("long").alias("next_access_vtime")).filter("obj_size > 0")


def sniff_csv(line: str) -> tuple[str, bool]:
    """(delimiter, has a header) from a first line: counts of tab, comma, bar and colon, the earlier ones weighing more; a header has no fewer letters than digits."""
    weights = {"\t": 4, ",": 3, "|": 2, ":": 1}
    sep = max(weights, key=lambda c: line.count(c) * weights[c])
    if sep not in line:
        raise ValueError(f"no delimiter in {line!r}")
    return sep, sum(c.isdigit() for c in line) <= sum(c.isalpha() for c in line)


def read_csv(spark: SparkSession, path: str, time: int, obj_id: int, obj_size: int | None = None, cnt: int | None = None, numeric_id: bool = True) -> DataFrame:
    """A delimited trace by 1-based columns, without order: see with_vtime. A count column stands for so many requests. A row whose time, id or size is no number stops the read, as it would leave a trace with a gap."""
    first = spark.read.text(path).first()
    sep, header = sniff_csv(first[0] if first else "")
    rows = spark.read.csv(path, sep=sep, header=header)
    col = lambda k: F.col(f"`{rows.columns[k - 1]}`")
    out = rows.select(
        F.floor(col(time).cast("double")).alias("clock_time"), (col(obj_id).cast("long") if numeric_id else F.xxhash64(col(obj_id))).alias("obj_id"),
        (col(obj_size).cast("long") if obj_size else F.lit(1).cast("long")).alias("obj_size"), (col(cnt).cast("int") if cnt else F.lit(1)).alias("cnt"), F.monotonically_increasing_id().alias("line"),
    )
    return out.filter("obj_size > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("cnt", F.lit(1))))).drop("cnt")


def read_ids(spark: SparkSession, path: str, numeric: bool = True) -> DataFrame:
    """One id per line; blank lines are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("line")).filter("v <> ''")
    return rows.select("line", (F.col("v").cast("long") if numeric else F.xxhash64("v")).alias("obj_id"), F.lit(1).cast("long").alias("obj_size"))


def write_binary(trace: DataFrame, folder: str, layout: str = "oracleGeneral") -> DataFrame:
    """Writes a trace, in order of vtime, as numbered parts of packed records whose concatenation is the file; returns a table of them. Each attempt of a task writes a file of its own name, and moves it to the part's when it is whole."""
    fields, kind = LAYOUTS[layout], _dtype(LAYOUTS[layout])
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in trace.columns else F.lit(0).cast("long").alias(c) for c, _ in fields]
    ordered = trace.select("vtime", *cols).repartitionByRange(n, "vtime").sortWithinPartitions("vtime")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), 0
        fs, at = _fs(f"{folder}/part-{part:06d}.bin")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        own = f"{at}.{uuid.uuid4().hex[:12]}.tmp"
        with fs.open_output_stream(own) as out:
            for b in batches:
                block = np.zeros(b.num_rows, kind)
                for c, _ in fields:
                    block[c] = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                out.write(block.tobytes())
                rows += b.num_rows
        fs.move(own, at)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.bin"], "n_req": [rows]})

    return ordered.mapInArrow(save, "part bigint, path string, n_req bigint")


