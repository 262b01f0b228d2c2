"""Edit-aware token counts.

A document's text is cut into leaves of some pre-tokens where the tokenizer never merges across (before a blank that
follows something else). The leaves' lengths and token counts are kept per document as a table of trees. An edit replaces
a range of characters: the leaves it touches, and one more on either side as boundary context, are encoded again, and the
sums on their paths to the root of the segment tree change. The root is the document's count. Only texts of edited
documents meet the trees, and only touched regions of them are encoded.

Defined cases: a null text is an empty text, with no leaves and count 0; edits that overlap an earlier one, or lie outside
the text, are left out; without edits both counts are equal; repeated rows are counted each; a null doc_id is an id like
any other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokenizer import Encoder, encoder, proven

CUT = re.compile(r"(?<=\S)(?= )")
TREE = "doc_id bigint, text_hash bigint, chars array<int>, tokens array<int>"
EDIT = "struct<start:int,end:int,new:string>"
BLANKS = np.isin(np.arange(128), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class CountParams:
    tokenizer: str
    #: Pre-tokens in a leaf, about.
    leaf: int = 16


def leaves_of(text: str, encode: Encoder, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths in characters, token counts) of a text's leaves."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if not proven(text):
        parts = CUT.split(text)
        parts = ["".join(parts[i : i + leaf]) for i in range(0, len(parts), leaf)]
        return np.array([len(x) for x in parts], np.int32), np.array([len(encode.ids(x)) // 4 for x in parts], np.int32)
    pieces = encode.pieces_of(text)
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    counts = np.fromiter(map(len, map(encode.pieces.__getitem__, pieces)), np.int32, len(pieces)) // 4
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # A leaf may start where a piece starts with a blank and what comes before isn't white space.
    blank = BLANKS[np.minimum(codes, 127)]
    safe = np.flatnonzero((codes[starts[1:]] == 32) & ~blank[starts[1:] - 1]) + 1
    cuts = np.concatenate([[0], safe[leaf - 1 :: leaf]])
    return np.add.reduceat(lengths, cuts), np.add.reduceat(counts, cuts)


class CountTree:
    """The tree of sums over a text's leaves: node k has the children 2k and 2k + 1, leaves start at `base`."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.text, self.n = text, len(tokens)
        self.base = 1 << max(0, self.n - 1).bit_length()
        self.tree = np.zeros(2 * self.base, np.int64)
        self.tree[self.base : self.base + self.n] = tokens
        level = self.base
        while level > 1:
            half = level >> 1
            self.tree[half:level] = self.tree[level : 2 * level : 2] + self.tree[level + 1 : 2 * level : 2]
            level = half
        self.starts = np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
        self.encoded_again = 0
        #: (first leaf, last leaf, lengths and counts of the leaves that replace them).
        self.replaced: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    @property
    def total(self) -> int:
        return int(self.tree[1])

    def _set(self, leaf: int, value: int) -> None:
        k = self.base + leaf
        change = value - int(self.tree[k])
        while k:
            self.tree[k] += change
            k >>= 1

    def apply(self, edits: list[tuple[int, int, str]], leaves) -> None:
        """Edits (start, end, new text) in order, by the positions in the text, once. leaves: a text's leaves. Runs of touched leaves are encoded as one region, whose sum stays in its first leaf."""
        if not self.n:
            # Edits of an empty text can only insert; there is nothing to keep.
            new = "".join(e[2] for e in edits)
            chars, tokens = leaves(new)
            self.tree[1], self.encoded_again = int(tokens.sum()), len(new)
            self.replaced = [(0, -1, chars, tokens)]
            return
        regions: list[list] = []
        for start, end, new in edits:
            first = min(self.n, int(np.searchsorted(self.starts, start, "right"))) - 1
            last = min(self.n, int(np.searchsorted(self.starts, max(start, end - 1), "right"))) - 1
            lo, hi = max(0, first - 1), min(self.n - 1, last + 1)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
                regions[-1][2].append((start, end, new))
            else:
                regions.append([lo, hi, [(start, end, new)]])
        done: list[list] = []
        for region in regions:
            region = self._widened(*region)
            while done and region[0] <= done[-1][1]:
                earlier = done.pop()
                region = self._widened(earlier[0], max(region[1], earlier[1]), [*earlier[2], *region[2]])
            done.append(region)
        for lo, hi, _, text in done:
            chars, tokens = leaves(text)
            self.encoded_again += len(text)
            self.replaced.append((lo, hi, chars, tokens))
            self._set(lo, int(tokens.sum()))
            for k in range(lo + 1, hi + 1):
                self._set(k, 0)

    def _widened(self, lo: int, hi: int, own: list[tuple[int, int, str]]) -> list:
        """A region that ends where the tokenizer never merges across, in the new text too, and its new text."""
        while True:
            at, out = int(self.starts[lo]), []
            for start, end, new in own:
                out += [self.text[at:start], new]
                at = end
            text = "".join([*out, self.text[at : int(self.starts[hi + 1])]])
            if hi + 1 < self.n and (not text or text[-1].isspace()):
                hi += 1
            elif lo > 0 and not text.startswith(" "):
                lo -= 1
            else:
                return [lo, hi, own, text]

    def leaves(self, chars: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves after the edits, from those before."""
        at, out = 0, []
        for lo, hi, c, t in self.replaced:
            out += [(chars[at:lo], tokens[at:lo]), (c, t)]
            at = hi + 1
        out.append((chars[at:], tokens[at:]))
        return np.concatenate([x for x, _ in out]).astype(np.int32), np.concatenate([x for _, x in out]).astype(np.int32)


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after the edits; what the counts of a tree must agree with."""
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def valid_edits(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, without those that overlap an earlier one or lie outside the text."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at and start <= end <= len(text):
            out.append((start, end, new))
            at = end
    return out


def text_hash(text: str) -> int:
    """What xxhash64() gives for the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def count_trees(docs: DataFrame, p: CountParams) -> DataFrame:
    """The trees to keep, a row for each document: doc_id, text_hash, chars and tokens (of each leaf)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.tokenizer)
        for b in batches:
            leaves = [leaves_of(t.as_py(), encode, p.leaf) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), _lists([c for c, _ in leaves]), _lists([t for _, t in leaves])], names=["doc_id", "text_hash", "chars", "tokens"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, TREE)


def touched_documents(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, edits of the documents that a table of edits (doc_id, start, end, new) names. The edits of one document come together; documents without edits stay where they are."""
    of_doc = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new"))).alias("edits"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(of_doc.withColumnRenamed("doc_id", "edited_id"), F.col("doc_id").eqNullSafe(F.col("edited_id")))
    return joined.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "edits")


def edited_trees(trees: DataFrame, touched: DataFrame, p: CountParams) -> DataFrame:
    """The kept trees after edits (touched: doc_id, text_hash, text, edits): text_hash, chars and tokens as they are now, n_tokens_before, n_tokens, n_edits, n_chars_encoded_again. Trees of documents without edits pass as they are."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.tokenizer)
        for b in batches:
            hashes, leaves, sums = [], [], []
            for h, chars, tokens, text, edits in zip(*(b.column(c) for c in ("text_hash", "chars", "tokens", "text", "edits")), strict=True):
                chars, tokens = np.asarray(chars.values, np.int32), np.asarray(tokens.values, np.int32)
                before = int(tokens.sum())
                if not edits.is_valid:
                    hashes.append(h.as_py())
                    leaves.append((chars, tokens))
                    sums.append((before, before, 0, 0))
                    continue
                text = text.as_py()
                own = valid_edits(text, [(e["start"], e["end"], e["new"] or "") for e in edits.as_py()])
                tree = CountTree(text, chars, tokens)
                tree.apply(own, lambda x: leaves_of(x, encode, p.leaf))
                hashes.append(text_hash(edited(text, own)))
                leaves.append(tree.leaves(chars, tokens))
                sums.append((before, tree.total, len(own), tree.encoded_again))
            counts = [pa.array([s[k] for s in sums], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(hashes, pa.int64()), _lists([c for c, _ in leaves]), _lists([t for _, t in leaves]), *counts],
                names=["doc_id", "text_hash", "chars", "tokens", "n_tokens_before", "n_tokens", "n_edits", "n_chars_encoded_again"],
            )

    once = touched.select(F.col("doc_id").alias("touched_id"), F.col("text_hash").alias("touched_hash"), "text", F.col("edits").cast(f"array<{EDIT}>").alias("edits")).dropDuplicates(["touched_id", "touched_hash"])
    met = trees.join(once, F.col("doc_id").eqNullSafe(F.col("touched_id")) & (F.col("text_hash") == F.col("touched_hash")), "left")
    out = TREE + ", n_tokens_before bigint, n_tokens bigint, n_edits bigint, n_chars_encoded_again bigint"
    return met.select("doc_id", "text_hash", "chars", "tokens", "text", "edits").mapInArrow(update, out)


DIGITS = re.compile(r"[0-9]{4,}")


def masked_numbers(docs: DataFrame) -> DataFrame:
    """Edits that replace each run of four or more digits by one mark, as doc_id, text_hash, text, edits of the documents that have such runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edits = [[{"start": m.start(), "end": m.end(), "new": "<number>"} for m in DIGITS.finditer(t.as_py())] for t in b.column("text")]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edits, kind)], names=[*b.schema.names, "edits"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter(F.col("text").rlike("[0-9]{4}"))
    return rows.mapInArrow(find, f"doc_id bigint, text_hash bigint, text string, edits array<{EDIT}>")


def edited_counts(docs: DataFrame, touched: DataFrame, p: CountParams) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_after, n_chars_encoded_again. The trees are written, then met by the edits."""
    trees = written(count_trees(docs.select("doc_id", "text"), p), "count-trees")
    return edited_trees(trees, touched, p).select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_chars_encoded_again")
