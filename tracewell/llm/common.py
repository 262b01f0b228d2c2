"""Helpers that the corpus operators share: word splitting, fold tests, and written intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java regular-expression class body.
ASCII_SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: No array that a text gives is longer; `slice` wants a length, and adds it to the start as an int.
ALL = 2**30

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (lower() would change other alphabets too)."""
    return F.translate(text, UPPER, LOWER)


def bit(place: Column) -> Column:
    """A long with the bit at place (0 to 63) set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset and Spark is local (tests), one is made and set; on a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: The folder of each table that written() made, and the list that the run in progress keeps of them.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once and a lost executor costs no recomputation. options: the Parquet writer's."""
    path = shared_dir(df.sparkSession, label)
    if (tables := _run.get()) is not None:
        tables.append(path)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def bucketed(df: DataFrame, label: str, n: int, *columns: str) -> DataFrame:
    """df as a table in the shared folder whose rows are in n buckets by these columns: groups and windows by them need no exchange. df should have few values of them in a task, as each task writes a file for each bucket it has."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    if (tables := _run.get()) is not None:
        tables.append(path)
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(n, *columns).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now; the name can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    _folders[out] = path
    return out


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in an order, in as many partitions as the session's shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def ranked(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """df with rank = 1, 2, ... in an order. Rows are range-partitioned and sorted; each partition starts where the ones before end, so no task sees all rows."""
    placed = written(ranges(df, *order).withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("part", (F.sum("n").over(before) - F.col("n")).alias("start"))
    # One row for each partition of the sort.
    joined = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "start", "place")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for t in tables:
        if folder := _folders.pop(t, None):
            _delete(t.sparkSession, folder)


@contextlib.contextmanager
def recorded(tables: list[str]) -> Iterator[None]:
    """Within the block, folders of written tables are added to the list: a run's own list, for release()."""
    before = _run.set(tables)
    try:
        yield
    finally:
        _run.reset(before)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Deletes a run's tables. Only after every result based on them is stored."""
    while tables:
        _delete(spark, tables.pop())


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast only what was counted and found small; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


class Recent(dict):
    """Values that make() gives for keys, kept for the keys that came up lately: when `limit` are held they become the old ones, and what is asked for again moves over. Keys of over `longest` characters or bytes are not kept, so that `limit` bounds bytes too."""

    def __init__(self, make: Callable, limit: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got
