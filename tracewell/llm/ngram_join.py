"""Exact Jaccard self-join of documents as sets of word 5-grams, and its connected components.

1. Copies: documents with the same set meet by a digest of it; one row stands for them.
2. Candidates: with the hashes of all sets in one order, rare ones first, two sets that link share a hash among the
   first quarter of each (the prefix). A table of hashed counts over all documents gives the order.
3. Stars: of the sets that share a prefix hash, each is compared with the smallest of its size band. Links found so
   far give components.
4. Tiles: where a prefix hash still joins sets of different components, its sets are cut into blocks of bounded length,
   by size band; blocks whose sizes can link are compared as tiles. Parity bitmaps bound the overlap from above (each
   bit that differs is an element that only one set has); pairs within the bound, and of different components, are
   compared exactly on their sorted arrays. Two rounds take each document's nearest only, the last one takes all that is left.
5. The links of both steps give the components.

No step loses a link between different components, so the components are exact; pairs inside a component that is known
already are not looked at again. A hash that very many sets share is dealt with in parts at each step: it is counted by
aggregations, cut into blocks without a sort, and its rows are dealt by more than the hash.

Defined cases: a null text, or one without words, has the empty set, which links with nothing; rows that repeat a doc_id
are one document, which links with whatever one of its texts links with; a null doc_id has a null component and links
with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitset import hashed_set, in_set
from .common import broadcast_if_small, discard, written
from .links import components, joined_components, with_smallest

#: Bits of the set of digests that occur more than once. More digests only send more rows through a join.
COPY_BITS = 1 << 22
#: Tasks that add up the counts of hash buckets, each its own range of them.
SKETCH_PARTS = 256
#: A prefix hash whose bucket counts so much, or so many times the mean bucket, is dealt in parts.
HOT_COUNT, HOT_TIMES, HOT_PARTS = 1024, 8, 64


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    percent: int = 75
    sketch_bits: int = 20
    bitmap_bits: int = 1024
    #: Sets in a block of a tile, about.
    block: int = 2048
    #: Size bands to the ratio at which sets can still link.
    bands: int = 3
    #: Ids of documents whose sets are needed are broadcast up to this number, and joined by a shuffle beyond it.
    max_broadcast_ids: int = 1_000_000


#: Odd multipliers, one for each place in an n-gram; powers of one fixed odd number.
PLACES = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)]
#: Words are hashed as polynomials of their bytes in an odd number modulo 2^64, so that sums over a text give all of them.
BASE = 0xD6E8FEB86659FD93
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PIECE = 1 << 18


def _byte_values() -> np.ndarray:
    """A random odd number for each byte, A-Z as a-z, and 0 for white space."""
    t = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    t[SPACES] = 0
    return t


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


VALUES, POWERS, INVERSE = _byte_values(), _powers(BASE, PIECE), _powers(pow(BASE, -1, 1 << 64), PIECE)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased, in order. A long text is summed up in pieces, and so is a long word."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = SPACES[raw]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    sums, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        lo = int(starts[k])
        upto = max(k + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        piece = raw[lo : min(int(ends[upto - 1]), lo + PIECE)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(VALUES[piece] * POWERS[: len(piece)], out=total[1:])
        at = starts[k:upto] - lo
        sums[k:upto] = (total[np.minimum(ends[k:upto] - lo, len(piece))] - total[at]) * INVERSE[at]
        # Only a word that is longer than a piece goes on.
        for more in range(lo + PIECE, int(ends[k]), PIECE):
            piece = raw[more : min(int(ends[k]), more + PIECE)]
            sums[k : k + 1] += (VALUES[piece] * POWERS[: len(piece)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(BASE, more - lo, 1 << 64))
        k = upto
    return _scramble(sums + (ends - starts).astype(np.uint64) * np.uint64(PLACES[15]))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word n-grams; of its whole sequence of words, if that is shorter."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    end = len(h) - k + 1
    sums = h[:end] * np.uint64(PLACES[0])
    for j in range(1, k):
        sums += h[j : j + end] * np.uint64(PLACES[j])
    sums = np.sort(_scramble(sums + np.uint64(k)))
    return sums[np.concatenate([[True], sums[1:] != sums[:-1]])]


def _parity_bits(s: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap, as bytes, where a bit is set if an odd number of hashes fall on it."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The same set's parity bitmap of a shorter length (in bytes)."""
    while len(bits) > length:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _count_sketch(docs: DataFrame, p: JoinParams) -> DataFrame:
    """(part, counts): how often each hash bucket occurs over all documents, in SKETCH_PARTS parts."""
    parts, size = SKETCH_PARTS, 1 << p.sketch_bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(size, np.int64), [], 0

        def add_up() -> None:
            nonlocal held, n
            if held:
                np.add(total, np.bincount(np.concatenate(held), minlength=size), out=total)
            held, n = [], 0

        for b in batches:
            for text in b["text"]:
                held.append((shingles(text, p.words) >> np.uint64(64 - p.sketch_bits)).astype(np.int64))
                n += len(held[-1])
                if n > size:
                    add_up()
        add_up()
        if total.any():
            yield pd.DataFrame({"part": np.arange(parts, dtype="int32"), "counts": [x.tobytes() for x in total.reshape(parts, -1)]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size // parts, np.int64)
        for f in frames:
            for c in f["counts"]:
                total += np.frombuffer(c, np.int64)
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})

    return docs.select("text").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")


def order_classes(docs: DataFrame, p: JoinParams) -> tuple[np.ndarray, int]:
    """The logarithm of each bucket's count, in 256 steps: 2^sketch_bits bytes whatever the corpus. And the class from which on a bucket holds a hash that is dealt in parts."""
    out = np.zeros(1 << p.sketch_bits, np.int64)
    width = len(out) // SKETCH_PARTS
    for r in _count_sketch(docs, p).collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    steps = lambda n: np.minimum(255, np.log2(np.maximum(n, 1)) * 4).astype(np.uint8)
    return steps(out), int(steps(np.array([max(HOT_COUNT, HOT_TIMES * out.mean())]))[0])


def _signatures(docs: DataFrame, classes: np.ndarray, p: JoinParams) -> DataFrame:
    """doc_id, n (size of the set), digest of the set, prefix (the first hashes in the order, their class in the upper 8 bits), bitmap (of one length for all), fine (a bitmap of four or more bits a hash)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(classes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = table.value
        for b in batches:
            n, digest, prefix, bitmap, fine = [], [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), p.words)
                keep = len(s) - (p.percent * len(s) + 99) // 100 + 1 if len(s) else 0
                order = (rank[(s >> np.uint64(64 - p.sketch_bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | ((s * np.uint64(PLACES[0])) >> np.uint64(8))
                if keep < len(order):
                    order = np.partition(order, keep - 1)[:keep]
                n.append(len(s))
                digest.append(_digest(s))
                prefix.append((order ^ np.uint64(1 << 63)).view(np.int64))  # signed longs in the same order
                bits = _parity_bits(s, max(p.bitmap_bits, 1 << (4 * len(s)).bit_length()))
                fine.append(bits.tobytes())
                bitmap.append(_folded(bits, p.bitmap_bits // 8).tobytes())
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(bitmap, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "digest", "prefix", "bitmap", "fine"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n bigint, digest binary, prefix array<bigint>, bitmap binary, fine binary")


def _sets_of(docs: DataFrame, ids: DataFrame, reps: DataFrame, p: JoinParams) -> DataFrame:
    """(id, arr): the sorted hashes, as bytes, of the sets with these ids, from the texts again."""
    wanted = written(reps.join(ids, "id", "left_semi").select("doc_id", "id", "digest"), "join-wanted")
    n = wanted.count()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), p.words) for t in b.column("text")]
            # Rows that repeat a doc_id may have other texts: the digest tells.
            same = pa.array([_digest(s) == d.as_py() for s, d in zip(sets, b.column("digest"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "arr"]).filter(same)

    return docs.select("doc_id", "text").join(broadcast_if_small(wanted, n, p.max_broadcast_ids), "doc_id").select("id", "digest", "text").mapInArrow(make, "id bigint, arr binary").dropDuplicates(["id"])


def _overlap_bound(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, p: JoinParams) -> np.ndarray:
    """Whether sets of these sizes, whose parity bitmaps differ in so many bits, may link."""
    overlap = (n_a + n_b - differ) // 2
    return (100 * np.minimum(n_a, n_b) >= p.percent * np.maximum(n_a, n_b)) & (100 * overlap >= p.percent * (n_a + n_b - overlap))


def _possible(pairs: DataFrame, bitmaps: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave a link possible."""
    side = lambda c: bitmaps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b"))

    def differing(x: bytes, y: bytes) -> int:
        u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        length = min(len(u), len(v))
        return int(np.bitwise_count(_folded(u, length).view(np.uint64) ^ _folded(v, length).view(np.uint64)).sum(dtype=np.int64))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = np.array([differing(x, y) for x, y in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)], np.int64)
            keep = _overlap_bound(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), differ, p)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-ids")
    sets = written(_sets_of(docs, ids, reps, p), "join-sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("arr").alias("arr_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("arr").alias("arr_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("arr_a"), b.column("arr_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least = min(len(u), len(v))
                if 100 * least < p.percent * max(len(u), len(v)):
                    keep.append(False)
                    continue
                small, large = (u, v) if len(u) <= len(v) else (v, u)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= p.percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "arr_a", "arr_b").mapInArrow(check, "a bigint, b bigint")


def tile_blocks(members: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """(members with band and part, cells): a token's sets cut into blocks, and the pairs of blocks to compare. members: token, id, n, m (sets of the token), ...

    A token of up to p.block sets is one block. The sets of others are cut by size band, and a band by a hash of the id
    into parts of about p.block. Cells are pairs of blocks, each pair once, whose sizes can link.
    """
    width = float(np.log(100 / p.percent)) / p.bands
    banded = members.withColumn("band", F.when(F.col("m") <= p.block, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / width)).cast("int"))
    bands = banded.groupBy("token", "band").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).withColumn("parts", F.ceil(F.col("c") / p.block).cast("int"))
    part = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # The rows of a band that is large or has a large token are dealt to several tasks.
    spread = lambda c: F.when(F.col(c) > HOT_COUNT, HOT_PARTS).otherwise(1)
    sized = bands.join(banded.select("token", "m").distinct().filter(F.col("m") > HOT_COUNT), "token", "left").withColumn("deals", spread("m")).withColumn("deal", part("deals"))
    rows = banded.withColumn("deal", F.pmod(F.xxhash64("id"), spread("m")).cast("int")).join(sized.select("token", "band", "deal", "parts"), ["token", "band", "deal"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "token"), F.col("parts")).cast("int")).drop("parts", "deal")
    blocks = bands.withColumn("part", part("parts")).withColumn("band_2", F.explode(F.sequence(F.col("band"), F.col("band") + p.bands + 1)))
    other = bands.select("token", F.col("band").alias("band_2"), F.col("low").alias("low_2"), F.col("parts").alias("parts_2"))
    cells = blocks.join(other, ["token", "band_2"]).filter(f"100 * high >= {p.percent} * low_2").withColumn("part_2", part("parts_2"))
    return rows, cells.filter("band < band_2 or part <= part_2").select("token", "band", "part", "band_2", "part_2")


def _tile_pairs(members: DataFrame, bitmaps: DataFrame, p: JoinParams, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components whose bitmaps leave a link possible: all, or for each document of a tile the one whose bitmap differs least. members: token, id, n, m, component."""
    rows, cells = tile_blocks(members, p)
    place = F.struct("token", "band", "part", "band_2", "part_2")
    same = (F.col("band") == F.col("band_2")) & (F.col("part") == F.col("part_2"))
    sides = cells.select(F.xxhash64(place).alias("tile"), F.hash(place).alias("tile_2"), same.alias("same"), "token", F.explode(F.when(same, F.array(F.struct(F.lit(0).alias("side"), "band", "part"))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), "band", "part"), F.struct(F.lit(1).alias("side"), F.col("band_2").alias("band"), F.col("part_2").alias("part"))))).alias("s"))
    dealt = sides.select("tile", "tile_2", "same", "token", "s.*").join(rows, ["token", "band", "part"]).select("tile", "tile_2", "same", "side", "id", "component")
    # Bitmaps come in last, so that they travel twice only: to the rows and to the tiles.
    dealt = dealt.join(bitmaps.select("id", "n", "bitmap"), "id").repartition("tile", "tile_2").sortWithinPartitions("tile", "tile_2", "side")

    def pairs_in(first: np.ndarray, second: np.ndarray, same: bool, n: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, i in enumerate(first):
            js = second[at + 1 :] if same else second
            js = js[comp[js] != comp[i]]
            if len(js):
                differ = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                may = _overlap_bound(n[js], n[i], differ, p)
                if may.any():
                    js = js[may][[differ[may].argmin()]] if nearest else js[may]
                    yield np.full(len(js), i), js

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "tile_2", "same", "side", "id", "n", "component"]

        def pairs_of(rows: list[np.ndarray], bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            _, _, same, side, ids, n, comp = rows
            got = []
            for s, e in zip(starts, ends, strict=True):
                at = np.arange(s, e)
                first, second = (at, at) if same[s] else (at[side[s:e] == 0], at[side[s:e] == 1])
                got += pairs_in(first, second, bool(same[s]), n, comp, bits)
            i, j = (ids[np.concatenate([g[k] for g in got])] if got else np.zeros(0, np.int64) for k in (0, 1))
            both = np.unique(np.stack([np.maximum(i, j), np.minimum(i, j)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        rows, bits = None, None
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            new_bits = np.frombuffer(b"".join(b.column("bitmap").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            if rows is not None:
                new, new_bits = [np.concatenate([x, y]) for x, y in zip(rows, new, strict=True)], np.concatenate([bits, new_bits])
            if not len(new[0]):
                continue
            starts = np.concatenate([[0], np.flatnonzero((new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])) + 1])
            # The last tile may go on in the next batch.
            yield pairs_of(new, new_bits, starts[:-1], starts[1:])
            rows, bits = [x[starts[-1] :] for x in new], new_bits[starts[-1] :]
        if rows is not None and len(rows[0]):
            yield pairs_of(rows, bits, np.array([0]), np.array([len(rows[0])]))

    return dealt.select(*["tile", "tile_2", "same", "side", "id", "n", "component"], "bitmap").mapInArrow(compare, "a bigint, b bigint").distinct()


def _one_per_set(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of signed that stand for a set each, sets): sets has digest, id (of that row), doc_id (of that row) and min_doc. Only sets that a small bit array says may have copies are joined; all other rows stay where they are."""
    real = signed.filter("doc_id is not null and n > 0")
    sets = written(real.groupBy("digest").agg(F.min(F.struct("id", "doc_id")).alias("row"), F.min("doc_id").alias("min_doc"), F.count("*").alias("copies")).select("digest", "row.id", "row.doc_id", "min_doc", "copies"), "join-sets")
    bits = written(hashed_set(sets.filter("copies > 1").select(F.xxhash64("digest").alias("h")), COPY_BITS), "join-copies")
    may = in_set(F.col("bits"), F.xxhash64("digest"), COPY_BITS)
    tested = real.withColumn("bits", bits.scalar()).withColumn("may", may).drop("bits")
    copied = written(tested.filter("may").join(sets.select("id"), "id", "left_semi"), "join-copied")
    return tested.filter("not may").unionByName(copied).drop("may"), sets.drop("copies")


def _met(rows: DataFrame, per: DataFrame, on: list[str], large: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each value of `on`. Where `large` holds, on both sides, the rows are dealt to several tasks."""
    parts = F.when(large, HOT_PARTS).otherwise(1)
    dealt = per.withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("deal", F.pmod(F.xxhash64("id"), parts).cast("int")).join(dealt, [*on, "deal"], how).drop("deal")


def shared_tokens(chosen: DataFrame, hot_class: int) -> DataFrame:
    """token, id, m (the token's sets): prefix hashes that two or more sets have, without those whose sets all meet at another one."""
    tokens = chosen.select("id", F.explode("prefix").alias("token"))
    # The class is in the upper 8 bits. A hot hash is dealt in parts; so is any other hash of its bucket.
    hot = F.shiftright("token", 56) + 128 >= hot_class
    parted = tokens.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    shared = parted.withColumn("members", F.count("*").over(Window.partitionBy("token", "salt"))).filter((F.col("members") > 1) | hot).select("token", "id")
    # A token is left out if all its sets have the same shared hash before this one: they all meet in that one's tile.
    # So a passage that documents share, with many hashes in their prefixes, makes one tile and not many.
    before = written(shared.withColumn("prev", F.lag("token").over(Window.partitionBy("id").orderBy("token"))), "join-shared")
    stat = before.groupBy("token").agg(F.count("*").alias("m"), F.min("prev").alias("low"), F.max("prev").alias("high"), F.count(F.when(F.col("prev").isNull(), 1)).alias("open"))
    kept = stat.filter("m > 1 and (open > 0 or low <> high)").select("token", "m")
    return _met(before.select("token", "id"), kept, ["token"], hot)


def _same_document(real: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that repeat a doc_id."""
    several = real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id", "low")
    each = real.select("doc_id", "digest").join(several, "doc_id").filter("digest <> low").distinct()
    ids = sets.select("digest", "id")
    return each.join(ids.withColumnRenamed("id", "a"), "digest").select("a", F.col("low").alias("digest")).join(ids.withColumnRenamed("id", "b"), "digest").select("a", "b")


def linked_components(docs: DataFrame, sets: DataFrame, members: DataFrame, bitmaps: DataFrame, first: DataFrame, given: DataFrame, p: JoinParams) -> DataFrame:
    """(id, component) of sets that candidates link. members: token, id, n, m (the token's sets): any two sets of a token are candidates. first: pairs (a, b) of these to look at before the others; given: links that are known."""
    large = F.col("m") > HOT_COUNT
    first = written(_possible(first, bitmaps, p), "join-first")
    links = written(_verified(first, docs, sets, p).unionByName(given), "join-links")
    comps = components(links)
    discard(first, links)
    # First each document's nearest in a tile, which joins most components; then whatever is left.
    for nearest in (True, True, False):
        known = with_smallest(members.select("token", "id", "n", "m"), comps)
        open_tokens = known.groupBy("token", "m").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token", "m")
        left = written(_met(known, open_tokens, ["token", "m"], large, "left_semi"), "join-open")
        pairs = written(_possible(_tile_pairs(left, bitmaps, p, nearest), bitmaps, p), "join-pairs")
        discard(left)
        # Where the nearest of every row fails by its finer bitmap, a farther one may still pass in the last round.
        if not pairs.head(1):
            continue
        found = written(_verified(pairs, docs, sets, p), "join-found")
        discard(pairs)
        comps = joined_components(comps, found)
        discard(found)
    return comps


def per_document(slim: DataFrame, sets: DataFrame, comps: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of slim (doc_id, n_shingles, digest)."""
    of_set = written(with_smallest(sets.select("id", "digest", "min_doc"), comps), "join-components")
    least = of_set.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    of_digest = of_set.select("digest", "component").join(least, "component").select("digest", "component_id")
    # A row without words counts as its document's other rows do, if there are some.
    other = slim.filter("n_shingles = 0 and doc_id is not null").select("doc_id").distinct().join(real_digests(slim), "doc_id")
    others = written(other, "join-others")
    rows = slim.join(broadcast_if_small(others, others.count(), p.max_broadcast_ids), "doc_id", "left").withColumn("digest", F.coalesce("digest", "other")).drop("other")
    return rows.join(of_digest, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    classes, hot_class = order_classes(docs, p)
    signed = written(_signatures(docs, classes, p).withColumn("id", F.monotonically_increasing_id()), "join-signed")
    real = signed.filter("doc_id is not null and n > 0").select("doc_id", "digest")
    chosen, sets = _one_per_set(signed)
    tokens = written(shared_tokens(chosen, hot_class), "join-tokens")
    sizes = chosen.select("id", "n", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / p.percent))).cast("int").alias("star_band"))
    members = written(tokens.join(sizes, "id"), "join-members")
    bitmaps = written(chosen.select("id", "n", "bitmap", "fine").join(members.select("id").distinct(), "id", "left_semi"), "join-bitmaps")
    slim = written(signed.select("doc_id", F.col("n").alias("n_shingles"), "digest"), "join-documents")
    same_document = written(_same_document(real, sets), "join-repeated")
    discard(signed, tokens)

    firsts = members.groupBy("token", "m", "star_band").agg(F.min(F.struct("n", "id"))["id"].alias("first"))
    stars = _met(members.select("token", "m", "star_band", "id"), firsts, ["token", "m", "star_band"], F.col("m") > HOT_COUNT).filter("id <> first").select(F.greatest("id", "first").alias("a"), F.least("id", "first").alias("b")).distinct()
    comps = linked_components(docs, sets, members, bitmaps, stars, same_document, p)
    discard(members, bitmaps)
    return per_document(slim, sets, comps, p)


def real_digests(slim: DataFrame) -> DataFrame:
    """(doc_id, other): the smallest digest of the sets of each document that has one."""
    return slim.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("other"))


def one_of_each(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; rows that repeat a doc_id stay, as do those with a null one."""
    kept = near_duplicates(docs, p).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
