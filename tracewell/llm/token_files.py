"""Token-id files: one zstandard frame for each document, and a seek table at the end.

A file holds a range of documents in ascending doc_id order. Its layout is that of seekable zstandard:

    frame of document 0 | frame of document 1 | ... | skippable frame with the doc_ids | skippable frame with the seek table

The frame of the doc_ids ends with the number of documents, first in the file, whose doc_id is null (they are written as 0).
The seek table has for each frame its compressed size, its size and a checksum (the low half of XXH64 of its content),
then the number of frames, a descriptor byte and a magic number. A reader that wants some documents reads the table,
finds them in the doc_ids, and decompresses their frames only. Content is ids as little-endian unsigned 32-bit integers.

Defined cases: a null text is an empty text (its document is the end id alone); a null doc_id comes first and
comes back as null; rows of one doc_id are ordered by their text; an empty table writes no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .tokenizer import encoder

#: Fixed values of the format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, TABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
SMALLEST, LARGEST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class FileParams:
    tokenizer: str
    end_id: int = 2
    level: int = 1


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, at = pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)
    return fs, at


class ShardWriter:
    """Writes one file; nothing but sizes and ids stays in memory. The file gets its name when it is complete."""

    def __init__(self, path: str, level: int) -> None:
        self.path, self.tmp = path, f"{path}.{uuid.uuid4().hex[:8]}.part"
        self.fs, at = _filesystem(self.tmp)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(at)
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.ids: list[int] = []
        self.without_id = 0
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """The next document; those with a null doc_id come first."""
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.without_id += doc_id is None
        self.ids.append(doc_id or 0)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes() + struct.pack("<I", self.without_id)
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(_filesystem(self.tmp)[1], _filesystem(self.path)[1])


class ShardReader:
    """Reads one file's table, then the frames that are asked for."""

    def __init__(self, path: str) -> None:
        fs, at = _filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != TABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        start = size - 9 - 12 * n
        self.entries = np.frombuffer(self.file.read_at(12 * n, start), "<u4").reshape(n, 3).astype(np.int64)
        ids = self.file.read_at(8 * n + 4, start - 8 - 4 - 8 * n)
        self.doc_ids, self.without_id = np.frombuffer(ids, "<i8", n), struct.unpack_from("<I", ids, 8 * n)[0]
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        """The ids of the file's k-th document, checked."""
        packed = self.file.read_at(int(self.entries[k, 0]), int(self.offsets[k]))
        ids = self.unpacker.decompress(packed, max_output_size=max(1, int(self.entries[k, 1])))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def documents(self, doc_id: int) -> list[bytes]:
        return [self.frame(int(k)) for k in np.flatnonzero(self.doc_ids == doc_id) if k >= self.without_id]

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, p: FileParams, n_files: int | None = None) -> DataFrame:
    """Writes docs into at most n_files files below folder and returns the written table of them: shard, path, first_id, n_docs, n_tokens, start (ids in the files before)."""
    spark = docs.sparkSession
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The text's hash keeps rows of one doc_id in the same order on every run, and in different files if need be.
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n_files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, writer, tokens = f"{folder}/shard-{shard:06d}.tokens.zst", None, 0
        encode = encoder(p.tokenizer)
        end = np.array([p.end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                writer = writer or ShardWriter(path, p.level)
                ids = encode.ids(text.as_py()) + end
                tokens += len(ids) // 4
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "first_id": pa.array([None if writer.without_id else writer.ids[0]], pa.int64()), "n_docs": [len(writer.ids)], "n_tokens": [tokens]})

    files = written(ranged.mapInArrow(write, "shard bigint, path string, first_id bigint, n_docs bigint, n_tokens bigint"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("start", F.sum("n_tokens").over(before) - F.col("n_tokens"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. A task reads one file after another, a frame at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = ShardReader(path)
                counts = shard.entries[:, 1] // 4
                starts = start + np.cumsum(counts) - counts
                crc = [zlib.crc32(shard.frame(k)) for k in range(len(counts))]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(counts)) < shard.without_id)
                shard.close()
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start", "shard").repartition(n, "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted doc_ids (a table with that column); only their frames are decompressed. Files are told apart by their first ids; a doc_id that several files hold is looked for in each."""
    first_id = F.coalesce("first_id", F.lit(SMALLEST))
    next_id = F.coalesce(F.lead("first_id").over(Window.orderBy("shard")), F.lit(LARGEST))
    ranges = F.broadcast(files.withColumn("first_id", first_id).withColumn("next_id", next_id).select("path", "first_id", "next_id"))  # a row for each file
    pairs = wanted.select("doc_id").filter("doc_id is not null").distinct().join(ranges, (F.col("doc_id") >= F.col("first_id")) & (F.col("doc_id") <= F.col("next_id")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, ShardReader] | None = None
        for b in batches:
            out_ids, out = [], []
            for path, doc_id in zip(b.column("path").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                if held is None or held[0] != path:
                    held = (path, ShardReader(path))
                for ids in held[1].documents(doc_id):
                    out_ids.append(doc_id)
                    out.append(np.frombuffer(ids, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out_ids, pa.int64()), "ids": pa.array(out, pa.list_(pa.int64()))})

    return pairs.repartition("path").sortWithinPartitions("path").select("path", "doc_id").mapInArrow(read, "doc_id bigint, ids array<bigint>")


def token_digest(spark: SparkSession, docs: DataFrame, p: FileParams) -> DataFrame:
    """Writes docs, reads the files back. Per document: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, shared_dir(spark, "token-shards"), p))
