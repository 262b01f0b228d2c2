"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full sets.

Each tree of the forest is an order of all documents by a signature of its own: `depth` minimum hashes, one after the
other. Documents with much in common stand next to each other in most trees.

1. Copies: documents with the same set meet by a digest of it; one row stands for them.
2. Neighbours: every tree is range-partitioned and sorted. A document and the next one share the longest prefix that it
   has in the tree; where they share least_depth hashes or more, the pair is a candidate. In a dense region neighbours
   agree to a greater depth than in a sparse one, so the depth of comparison follows the region. Rows and candidates are
   linear in documents and trees, whatever the size of a group.
3. Regions: documents that share least_depth hashes of a tree are a region. Where links found so far leave a region with
   several components, its documents of different components are compared as tiles, by bitmaps and then exactly. So
   nothing in a dense region is cut off by its depth.
4. Links give components.

Two sets with similarity 0.8 share no region of the 40 trees, of 4 hashes each, with a chance of (1 - 0.8^4)^40 = 7e-10.

Defined cases: a null text, or one without words, has the empty set, which links with nothing; rows that repeat a doc_id
are one document, which links with whatever one of its texts links with; a null doc_id has a null component and is not
kept; an empty table gives an empty result. A very long text is shingled whole, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ranges, written
from .ngram_join import JoinParams, _digest, _folded, _one_per_set, _parity_bits, _same_document, linked_components, per_document, shingles


@dataclass(frozen=True)
class ForestParams(JoinParams):
    words: int = 2
    percent: int = 80
    trees: int = 40
    #: Hashes of a tree's signature, and those that candidates share at least.
    depth: int = 6
    least_depth: int = 4
    seed: int = 29
    #: A region with one of so many rows is broadcast; there are no more such regions than that.
    hot_share: int = 1000


def multipliers(p: ForestParams) -> np.ndarray:
    """An odd number for each hash of each tree."""
    return np.random.default_rng(p.seed).integers(0, 1 << 31, p.trees * p.depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each multiplier the smallest product with a set's hashes (their upper 32 bits), in pieces that stay in the cache."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(by), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (by[:, None] * x[None, k : k + 512]).min(1), out=out)
    return out


def signatures(docs: DataFrame, p: ForestParams) -> DataFrame:
    """doc_id, n (size of the set), digest, trees (a signature for each tree: big-endian hashes as bytes), bitmap, fine."""
    by = multipliers(p)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, trees, bitmap, fine = [], [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), p.words)
                n.append(len(s))
                digest.append(_digest(s))
                whole = min_hashes(s, by).astype(">u4").tobytes() if len(s) else b""
                trees.append([whole[k : k + 4 * p.depth] for k in range(0, len(whole), 4 * p.depth)])
                bits = _parity_bits(s, max(p.bitmap_bits, 1 << (4 * len(s)).bit_length()))
                fine.append(bits.tobytes())
                bitmap.append(_folded(bits, p.bitmap_bits // 8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(trees, pa.list_(pa.binary())), pa.array(bitmap, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "digest", "trees", "bitmap", "fine"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n bigint, digest binary, trees array<binary>, bitmap binary, fine binary")


def neighbours(forest: DataFrame, p: ForestParams) -> DataFrame:
    """Pairs (a, b) of documents that stand next to each other in a tree and share least_depth hashes. forest: tree, sig, id. The two ends of a partition are not compared; regions make up for it."""
    ordered = ranges(forest, "tree", "sig", "id")

    def next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows < 2:
                continue
            ids, tree = b.column("id").to_numpy(), b.column("tree").to_numpy()
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)[:, : p.least_depth]
            same = (tree[1:] == tree[:-1]) & (sig[1:] == sig[:-1]).all(1)
            a, c = ids[1:][same], ids[:-1][same]
            both = np.unique(np.stack([np.maximum(a, c), np.minimum(a, c)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(next_to, "a bigint, b bigint").distinct()


def regions(forest: DataFrame, p: ForestParams) -> DataFrame:
    """token, id, m: documents of a region (token) with two or more, and their number. forest: token, id."""
    sizes = written(forest.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "forest-regions")
    rows = forest.count()
    hot = F.col("m") * p.hot_share >= rows
    met = forest.join(F.broadcast(sizes.filter(hot).withColumnRenamed("m", "hot_m")), "token", "left")
    common = met.filter("hot_m is not null").select("token", "id", F.col("hot_m").alias("m"))
    return common.unionByName(met.filter("hot_m is null").select("token", "id").join(sizes.filter(~hot).hint("merge"), "token"))


def forest_duplicates(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, p).withColumn("id", F.monotonically_increasing_id()), "forest-signed")
    real = signed.filter("doc_id is not null and n > 0").select("doc_id", "digest")
    chosen, sets = _one_per_set(signed)
    each = chosen.select("id", F.posexplode("trees").alias("tree", "sig"))
    forest = written(each.withColumn("token", F.xxhash64("tree", F.substring("sig", 1, 4 * p.least_depth))), "forest-trees")
    members = written(regions(forest.select("token", "id"), p).join(chosen.select("id", "n"), "id"), "forest-members")
    bitmaps = written(chosen.select("id", "n", "bitmap", "fine").join(members.select("id").distinct(), "id", "left_semi"), "forest-bitmaps")
    slim = written(signed.select("doc_id", F.col("n").alias("n_shingles"), "digest"), "forest-documents")
    same_document = written(_same_document(real, sets), "forest-repeated")
    first = written(neighbours(forest, p), "forest-neighbours")
    discard(signed, forest)
    comps = linked_components(docs, sets, members, bitmaps, first, same_document, p)
    discard(members, bitmaps, first)
    rows = per_document(slim, sets, comps, p)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each_forest(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; rows that repeat a doc_id stay, as do those with a null one."""
    kept = forest_duplicates(docs, p).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
