"""Trace files as a Spark data source: spark.read.format("trace") and df.write.format("trace"), after register(spark).

A written trace is a folder: pieces of packed records whose concatenation is the file, and numbered lists of pieces (`_trace-000001.json`), of which
the last one counts. A task attempt writes pieces of its own name; only those of the attempts that Spark commits come into the list, so lost,
repeated or failed attempts leave nothing that a reader sees. A single file of any layout is read as well.

Options: path; layout (a name of LAYOUTS, lcs, vscsi, or auto: the folder's own, or by the file's name); recordsPerRange; for writing: text (true: a text twin
of every piece), n_obj and n_obj_byte (what the header of a self-describing trace says about its objects).
Columns: vtime and the layout's fields, all bigint. A schema with fewer of them reads fewer of them. Limits on vtime become ranges of records.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..operators.prep import working_set
from .formats import LAYOUTS, LCS_FIELDS, LCS_HEADER, LCS_MAGIC, PLUS_ONE, _dtype, _fs, _head, layout_by_name, lcs_layout, vscsi_version

#: The header with its four statistics: requests, objects, bytes requested, bytes of objects.
LCS_WITH_STATISTICS = struct.Struct("<Q240s9B231x4q480xIIQQ")
STATISTICS = ["n_req", "n_obj", "n_req_byte", "n_obj_byte"]
#: Fields of the self-describing traces written here.
LCS_WRITTEN = [("clock_time", "I"), ("obj_id", "Q"), ("obj_size", "I"), ("next_access_vtime", "Q")]
#: Most ranges of a read; beyond, ranges grow. Records are read so many at a time, whatever the range.
MAX_RANGES, BLOCK = 20_000, 1 << 16
TOP = 1 << 62


def lcs_head(fields: list[tuple[str, str]], n_req: int, n_obj: int, n_req_byte: int, n_obj_byte: int) -> bytes:
    """The header of a self-describing trace."""
    place = {c: k + 1 for k, (c, _) in enumerate(fields)}
    fmt = "<" + "".join(code for _, code in fields)
    return LCS_WITH_STATISTICS.pack(LCS_MAGIC, fmt.encode(), *(place.get(c, 0) for c in LCS_FIELDS), n_req, n_obj, n_req_byte, n_obj_byte, len(fields), struct.calcsize(fmt), 1, LCS_MAGIC)


def lcs_statistics(head: bytes) -> dict[str, int]:
    """What a header says of its trace."""
    return dict(zip(STATISTICS, LCS_WITH_STATISTICS.unpack(head)[11:15], strict=True))


def header_statistics(path: str) -> dict[str, int]:
    """The statistics of a self-describing trace, a folder or a single file."""
    found = trace_list(path)
    return lcs_statistics(_head(f"{path}/{found['header']}" if found else path, LCS_HEADER.size))


@dataclass
class Piece(InputPartition):
    """Records of a file: n of them from a byte on, of which the first is request base + 1 of the trace. n < 0: an unpacked stream, to its end."""

    path: str
    start: int
    n: int
    base: int


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote."""

    file: str
    text: str
    n_req: int
    n_req_byte: int
    first: int
    last: int


def _lists(path: str) -> list[str]:
    """Names of the lists of pieces in a folder, the one that counts last."""
    fs, at = _fs(path)
    found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("_trace-") and f.base_name.endswith(".json"))


def trace_list(path: str) -> dict | None:
    """The list of a folder's pieces: layout, fields, header (its file, or empty), pieces with file, text and n_req. None if path holds no list."""
    fs, at = _fs(path)
    if fs.get_file_info(at).type != pa.fs.FileType.Directory or not (names := _lists(path)):
        return None
    with fs.open_input_stream(f"{at}/{names[-1]}", compression=None) as file:
        return json.loads(file.read())


def _described(path: str, layout: str) -> tuple[list[tuple[str, str]], str, int, dict | None]:
    """Fields, layout, bytes of header and, for a folder, its list."""
    if found := trace_list(path):
        return [tuple(f) for f in found["fields"]], found["layout"], 0, found
    layout = layout_by_name(path) if layout == "auto" else layout
    if layout == "lcs":
        return lcs_layout(_head(path, LCS_HEADER.size)), layout, LCS_HEADER.size, None
    return LAYOUTS[vscsi_version(_head(path, 16)) if layout == "vscsi" else layout], layout, 0, None


class TraceReader(DataSourceReader):
    def __init__(self, path: str, layout: str, columns: list[str], step: int) -> None:
        self.path, self.columns, self.step = path, columns, step
        self.fields, self.layout, self.header, self.listed = _described(path, layout)
        if unknown := set(columns) - {"vtime", *(c for c, _ in self.fields)}:
            raise ValueError(f"{path} has no {', '.join(sorted(unknown))}")
        self.low, self.high = 1, TOP

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Limits on vtime choose records; all other filters stay with Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("vtime",) or isinstance(f, In) and not (value and all(isinstance(v, int) for v in value)):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, value - isinstance(f, LessThan))
            elif isinstance(f, In):
                self.low, self.high = max(self.low, min(value)), min(self.high, max(value))
                yield f
            elif not isinstance(f, IsNotNull):
                yield f

    def _files(self) -> Iterator[tuple[str, int, int]]:
        """Path, bytes before the first record and number of records of each file of the trace, in order."""
        width = _dtype(self.fields).itemsize
        if self.listed is not None:
            for p in self.listed["pieces"]:
                yield f"{self.path}/{p['file']}", 0, p["n_req"]
            return
        fs, at = _fs(self.path)
        size = fs.get_file_info(at).size - self.header
        if size % width:
            raise ValueError(f"{self.path}: {size} bytes are no whole number of records of {width}")
        yield self.path, self.header, size // width

    def partitions(self) -> list[InputPartition]:
        if self.path.endswith(".zst"):
            return [Piece(self.path, self.header, -1, 0)]
        width, files, out, base = _dtype(self.fields).itemsize, list(self._files()), [], 0
        wanted = max(0, min(self.high, sum(n for _, _, n in files)) - self.low + 1)
        step = max(self.step, -(-wanted // MAX_RANGES))
        for path, start, n in files:
            first, last = max(self.low - base, 1), min(self.high - base, n)
            out += [Piece(path, start + (k - 1) * width, min(step, last - k + 1), base + k - 1) for k in range(first, last + 1, step)]
            base += n
        return out or [Piece(self.path, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        kind = _dtype(self.fields)
        fs, at = _fs(partition.path)
        if partition.n < 0:
            with fs.open_input_stream(at, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as unpacked:
                unpacked.read(partition.start)
                left, done = b"", 0
                while done < self.high and (block := unpacked.read(kind.itemsize * BLOCK)):
                    block = left + block
                    left = block[len(block) // kind.itemsize * kind.itemsize :]
                    rows = np.frombuffer(block[: len(block) - len(left)], kind)
                    first, last = max(0, self.low - 1 - done), min(len(rows), self.high - done)
                    if first < last:
                        yield self._batch(rows[first:last], done + first)
                    done += len(rows)
                if left:
                    raise ValueError(f"{partition.path}: {len(left)} bytes are left after the last record")
            return
        if partition.n:
            with fs.open_input_file(at) as file:
                for k in range(0, partition.n, BLOCK):
                    n = min(BLOCK, partition.n - k)
                    data = file.read_at(n * kind.itemsize, partition.start + k * kind.itemsize)
                    yield self._batch(np.frombuffer(data, kind), partition.base + k)

    def _batch(self, rows: np.ndarray, before: int) -> pa.RecordBatch:
        """The columns asked for, ids by their 64 bits."""
        codes, cols = dict(self.fields), []
        for c in self.columns:
            if c == "vtime":
                cols.append(np.arange(before + 1, before + len(rows) + 1))
            else:
                whole = rows[c].view(np.int64) if codes[c] == "Q" and rows[c].flags.c_contiguous else rows[c].astype(np.uint64).view(np.int64) if codes[c] == "Q" else rows[c].astype(np.int64)
                cols.append(whole - (c in PLUS_ONE.get(self.layout, ())))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=self.columns)


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str, columns: list[str], overwrite: bool, text: bool, n_obj: int, n_obj_byte: int) -> None:
        self.path, self.layout, self.overwrite, self.text, self.objects = path.rstrip("/"), layout, overwrite, text, (n_obj, n_obj_byte)
        self.fields = LCS_WRITTEN if layout == "lcs" else LAYOUTS[layout]
        if missing := {"vtime", "obj_id"} - set(columns):
            raise ValueError(f"a trace needs {', '.join(sorted(missing))}")
        self.job = f"data-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        name = f"{self.job}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done = Written("", "", 0, 0, 0, 0)
        fs, at = _fs(f"{self.path}/{name}")
        out = twin = None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{at}.bin")
                    twin = fs.open_output_stream(f"{at}.txt") if self.text else None
                    done.file, done.text = f"{name}.bin", f"{name}.txt" if self.text else ""
                block, place = self._packed(b)
                if done.n_req and place[0] <= done.last or (np.diff(place) <= 0).any():
                    raise ValueError("requests of a task are not in the order of vtime")
                out.write(block.tobytes())
                if twin is not None:
                    lines = pa.table({c: block[c].view(np.int64) if c == "next_access_vtime" else block[c] for c in ("clock_time", "obj_id", "obj_size", "next_access_vtime") if c in block.dtype.names})
                    pa.csv.write_csv(lines, twin, pa.csv.WriteOptions(include_header=False))
                done.first = done.first or int(place[0])
                done.last, done.n_req = int(place[-1]), done.n_req + len(place)
                done.n_req_byte += int(block["obj_size"].sum(dtype=np.int64)) if "obj_size" in block.dtype.names else 0
        finally:
            for stream in (out, twin):
                if stream is not None:
                    stream.close()
        return done

    def _packed(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Records and their vtime. A null id or vtime, or a number that its field can't hold, is an error; other nulls are 0, and no next access is -1."""
        block = np.zeros(b.num_rows, _dtype(self.fields))
        for c, code in self.fields:
            if c not in b.schema.names:
                block[c] = np.int64(-1).astype(block[c].dtype) if c == "next_access_vtime" else 0
                continue
            col = b.column(c).cast(pa.int64())
            if c == "obj_id" and col.null_count:
                raise ValueError("a request without an id")
            values = col.fill_null(-1 if c == "next_access_vtime" else 0).to_numpy(zero_copy_only=False) + (c in PLUS_ONE.get(self.layout, ()))
            block[c] = values.view(np.uint64) if code == "Q" else values
            if code != "Q" and (block[c].astype(np.int64) != values).any():
                raise ValueError(f"{c} has numbers that {code} can't hold")
        if b.column("vtime").null_count:
            raise ValueError("a request without vtime")
        return block, b.column("vtime").cast(pa.int64()).to_numpy(zero_copy_only=False)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the pieces of the committed attempts, in the order of vtime. Of a folder that is written over, what was there before goes afterwards."""
        new = sorted((m for m in messages if m is not None and m.n_req), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(new, new[1:], strict=False)):
            raise ValueError("ranges of vtime of different tasks overlap: see write_trace")
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        names, old = _lists(self.path), trace_list(self.path)
        kept = old if old and not self.overwrite else {"pieces": []}
        if kept["pieces"] and kept["layout"] != self.layout:
            raise ValueError(f"{self.path} has the layout {kept['layout']}, not {self.layout}")
        pieces = kept["pieces"] + [{"file": m.file, "text": m.text, "n_req": m.n_req, "n_req_byte": m.n_req_byte} for m in new]
        header = ""
        if self.layout == "lcs":
            header = f"{self.job}/header.bin"
            fs.create_dir(f"{at}/{self.job}", recursive=True)
            with fs.open_output_stream(f"{at}/{header}") as out:
                out.write(lcs_head(self.fields, sum(p["n_req"] for p in pieces), self.objects[0], sum(p["n_req_byte"] for p in pieces), self.objects[1]))
        number = int(names[-1][7:-5]) + 1 if names else 1
        own = f"{at}/{uuid.uuid4().hex[:12]}.tmp"
        with fs.open_output_stream(own) as out:
            out.write(json.dumps({"layout": self.layout, "fields": self.fields, "header": header, "pieces": pieces}).encode())
        fs.move(own, f"{at}/_trace-{number:06d}.json")
        if self.overwrite and old:
            for name in names:
                fs.delete_file(f"{at}/{name}")
            for job in {p["file"].partition("/")[0] for p in old["pieces"]}:
                fs.delete_dir(f"{at}/{job}")

    def abort(self, messages: list[Written | None]) -> None:
        """What attempts of this write left so far is deleted; what was listed before stays. Tasks that Spark hasn't stopped yet may leave more, which no list names: see remove_unlisted."""
        fs, at = _fs(f"{self.path}/{self.job}")
        if fs.get_file_info(at).type == pa.fs.FileType.Directory:
            fs.delete_dir(at)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        fields = _described(self.options["path"], self.options.get("layout", "auto"))[0]
        return "vtime bigint, " + ", ".join(f"{c} bigint" for c, _ in fields)

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(self.options["path"], self.options.get("layout", "auto"), schema.names, int(self.options.get("recordsPerRange", 1 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> TraceWriter:
        o = self.options
        return TraceWriter(o["path"], o.get("layout", "oracleGeneral"), schema.names, overwrite, o.get("text", "false").lower() == "true", int(o.get("n_obj", 0)), int(o.get("n_obj_byte", 0)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand it limits on vtime."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def read_trace_source(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str | int) -> DataFrame:
    """A trace, of which only the columns asked for are unpacked."""
    register(spark)
    reader = spark.read.format("trace").options(**options)
    return (reader.schema(", ".join(f"{c} bigint" for c in columns)) if columns else reader).load(path)


def write_trace(trace: DataFrame, path: str, layout: str = "oracleGeneral", mode: str = "overwrite", text: bool = False) -> None:
    """Writes a trace in the order of vtime, each task a range of it. Read back, requests are numbered by their place. Fields that the trace lacks are 0. For lcs, objects are counted for the header; one that is appended to describes the objects of the last write only, so this refuses it."""
    if layout == "lcs" and mode == "append":
        raise ValueError("the header of a self-describing trace counts objects, which can't be added up: write it whole")
    register(trace.sparkSession)
    names = ["vtime", *(c for c, _ in (LCS_WRITTEN if layout == "lcs" else LAYOUTS[layout]) if c in trace.columns)]
    rows = trace.select(*names)
    options = dict(zip(["n_obj", "n_obj_byte"], [x or 0 for x in working_set(rows).first()], strict=True)) if layout == "lcs" else {}
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "vtime").sortWithinPartitions("vtime")
    ordered.write.format("trace").options(layout=layout, text=str(text).lower(), **options).mode(mode).save(path)


def remove_unlisted(path: str, older_than: float = 86_400) -> list[str]:
    """Deletes the folders of writes that are in no list, unless something in them is younger than so many seconds: a write may be on its way."""
    fs, at = _fs(path)
    listed = {p["file"].partition("/")[0] for p in (trace_list(path) or {"pieces": []})["pieces"]}
    if found := trace_list(path):
        listed.add(found["header"].partition("/")[0])
    gone = []
    for f in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
        if f.base_name.startswith("data-") and f.base_name not in listed:
            ages = [time.time() - x.mtime.timestamp() for x in [f, *fs.get_file_info(pa.fs.FileSelector(f.path))] if x.mtime]
            if min(ages, default=0) >= older_than:
                fs.delete_dir(f.path)
                gone.append(f.base_name)
    return gone


def text_twin(spark: SparkSession, path: str) -> DataFrame:
    """line: the text beside a trace that was written with it."""
    files = [f"{path}/{p['text']}" for p in trace_list(path)["pieces"] if p["text"]]
    return spark.read.schema("value string").text(files).withColumnRenamed("value", "line") if files else spark.createDataFrame([], "line string")
