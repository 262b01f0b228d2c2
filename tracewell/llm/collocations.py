"""Phrase collocations: phrases of two and three words whose parts seldom stand without each other.

1. Words: each task turns texts into word numbers of its own, in chunks of bounded length per language, and keeps the
   chunk's word list with counts. All lists together give the words' counts. A word that is rarer than a candidate has
   to be cannot be part of one, so only the others get a corpus-wide number, the rarer the larger.
2. Counting: a chunk's phrases go into a HAT-trie. Its inner nodes are keyed by word numbers and few levels deep; its
   leaves are containers, open-addressing hash tables that hold the phrases of a range of first words, or, below a common
   first word, of a range of second words. A container that grows too large bursts into two of shorter ranges. When the
   trie holds its limit, whole subtrees, the largest first, are written out as sorted runs and their containers emptied.
3. Merging: runs are cut by a hash of the phrase's path into prefix partitions of bounded length, and meet there. Sorted
   runs are merged and phrases with fewer than min_count occurrences dropped. A phrase has a row a run at most, so a very
   common one is no large group.
4. Scores: phrases meet the counts of their parts in joins; whole numbers only, in decimals of 38 digits.

Defined cases: a null text is empty; a null language is `und`; repeated rows count each; an empty table gives an empty
result. A very long text is cut between pieces, and within a piece at a word, with the two words before it carried over
uncounted. Counts are exact below 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, ranked, written

#: A-Z lower-cased; characters that end a piece become newlines. Blanks and tabs are what is left to split at.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PREPARED = bytes.maketrans(UPPER.encode() + ENDS, LOWER.encode() + b"\n" * len(ENDS))
#: Bits of a word's number in a packed phrase of three.
BITS = 21


@dataclass(frozen=True)
class PhraseParams:
    min_count: int = 10
    #: A phrase goes if one of so many hundredths of its occurrences contains it.
    cover_percent: int = 50
    top: int = 2000
    #: Words in a chunk, about.
    chunk_words: int = 1 << 20
    #: Entries of a trie before it spills, and of a container before it bursts.
    trie_entries: int = 1 << 21
    container_entries: int = 1 << 15
    #: Entries of a prefix partition before its runs are merged, at most.
    partition_entries: int = 1 << 21
    #: Word lists up to this number of rows are broadcast.
    max_broadcast_words: int = 200_000


class _Numbers(dict):
    """Numbers words from 1 as they come; the newline is 0."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """A list of word numbers, pieces ended by 0; negative where words are carried over from the chunk before."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.n = _Numbers(), [], 0

    def add(self, words: list[bytes], carried: int = 0) -> None:
        part = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        part[:carried] *= -1
        self.parts.append(part)
        self.n += len(part)

    def row(self) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[ids > 0], minlength=len(self.numbers))[1:]
        words = list(self.numbers)[1:]
        return {"words": words, "counts": counts.tolist(), "ids": zstandard.ZstdCompressor(level=1).compress(ids.tobytes())}


def word_chunks(docs: DataFrame, p: PhraseParams) -> DataFrame:
    """lang, words, counts (of each), ids (the words' places in the list, from 1, with breaks; compressed)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Chunk] = {}

        def closed(lang: str) -> pa.RecordBatch:
            row = opened.pop(lang).row()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([row["words"]], pa.list_(pa.binary())), pa.array([row["counts"]], pa.list_(pa.int64())), pa.array([row["ids"]], pa.binary())], names=["lang", "words", "counts", "ids"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                words: list[bytes] = []
                for piece in text.as_py().encode("utf-8", "surrogatepass").translate(PREPARED).split(b"\n"):
                    own = piece.split()
                    if len(own) > p.chunk_words:
                        opened.setdefault(lang, Chunk()).add([*words, *own[: p.chunk_words], b"\n"])
                        yield closed(lang)
                        for k in range(p.chunk_words, len(own), p.chunk_words):
                            opened.setdefault(lang, Chunk()).add([*own[max(0, k - 2) : k + p.chunk_words], b"\n"], min(2, k))
                            yield closed(lang)
                        words = []
                    elif own:
                        words += own
                        words.append(b"\n")
                        if len(words) > p.chunk_words:
                            opened.setdefault(lang, Chunk()).add(words)
                            yield closed(lang)
                            words = []
                if words:
                    chunk = opened.setdefault(lang, Chunk())
                    chunk.add(words)
                    if chunk.n > p.chunk_words:
                        yield closed(lang)
                # Many languages share the room of four chunks.
                if len(opened) > 4 and sum(c.n for c in opened.values()) > 4 * p.chunk_words:
                    yield closed(max(opened, key=lambda x: opened[x].n))
        for lang in list(opened):
            yield closed(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "lang string, words array<binary>, counts array<bigint>, ids binary")


def word_numbers(chunks: DataFrame, p: PhraseParams) -> DataFrame:
    """lang, word, f, rank: words with min_count occurrences or more, numbered from 1 by count."""
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    frequent = each.filter(F.col("f") >= p.min_count)
    return ranked(frequent, "phrase-order", F.col("f").desc(), F.col("lang"), F.col("word"))


class Container:
    """A hash table from packed phrases to counts: open addressing in two arrays."""

    def __init__(self, size: int = 1 << 10) -> None:
        self.keys, self.counts, self.used = np.zeros(size, np.int64), np.zeros(size, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys are distinct."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held, n = self.sorted()
            self.__init__(1 << (4 * (self.used + len(keys))).bit_length())
            self.add(held, n)
        mask = len(self.keys) - 1
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - mask.bit_length())).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several, one gets the slot
            hit = self.keys[at] == keys
            self.counts[at[hit]] += counts[hit]
            self.used += int((free & hit).sum())
            keys, counts, at = keys[~hit], counts[~hit], (at[~hit] + 1) & mask

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.keys)
        at = at[np.argsort(self.keys[at])]
        return self.keys[at], self.counts[at]


class HatTrie:
    """Counts of packed phrases. The inner nodes are kept as the lowest phrases of their leaves, in order: a leaf's range begins and ends between two first words, or, where a first word has several leaves, between two second words."""

    def __init__(self, container_entries: int) -> None:
        self.limit, self.lows, self.leaves = container_entries, np.zeros(1, np.int64), [Container()]

    @property
    def used(self) -> int:
        return sum(x.used for x in self.leaves)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys are distinct and sorted."""
        ends = np.append(np.searchsorted(keys, self.lows[1:]), len(keys))
        start, full = 0, []
        for k, end in enumerate(ends):
            if end > start:
                self.leaves[k].add(keys[start:end], counts[start:end])
                if self.leaves[k].used > self.limit:
                    full.append(k)
            start = end
        for k in reversed(full):
            self._burst(k)

    def _burst(self, k: int) -> None:
        keys, counts = self.leaves[k].sorted()
        for shift in (2 * BITS, BITS):
            node = keys >> shift
            if node[0] != node[-1]:
                middle = node[len(node) // 2]
                low = (middle if middle != node[0] else node[np.searchsorted(node, middle, "right")]) << shift
                break
        else:
            return  # the phrases of one pair of words stay together
        at = int(np.searchsorted(keys, low))
        both = [Container(), Container()]
        both[0].add(keys[:at], counts[:at])
        both[1].add(keys[at:], counts[at:])
        self.leaves[k : k + 1] = both
        self.lows = np.insert(self.lows, k + 1, low)
        for side in (1, 0):
            if both[side].used > self.limit:
                self._burst(k + side)

    def spill(self, entries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of whole subtrees, the largest first, until so many entries or fewer are left. A subtree is a first word with several leaves, or a leaf of several first words."""
        first = self.lows >> (2 * BITS)
        below = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        subtrees = [range(a, b) for a, b in zip(below, np.append(below[1:], len(first)), strict=True)]
        left = self.used
        for own in sorted(subtrees, key=lambda s: -sum(self.leaves[k].used for k in s)):
            if left <= entries:
                break
            runs = [self.leaves[k].sorted() for k in own]
            for k in own:
                left -= self.leaves[k].used
                self.leaves[k] = Container()
            keys, counts = (np.concatenate([r[j] for r in runs]) for j in (0, 1))
            if len(keys):
                yield keys, counts


def phrases_of(ids: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed phrases of two and three words, counts), sorted. ids: word numbers, 0 where no phrase goes on; counted: whether a phrase that ends here counts."""
    pair = (ids[:-1] > 0) & (ids[1:] > 0)
    two = ((ids[:-1] << (2 * BITS)) | (ids[1:] << BITS))[pair & counted[1:]]
    triple = pair[:-1] & pair[1:] & counted[2:]
    three = ((ids[:-2] << (2 * BITS)) | (ids[1:-1] << BITS) | ids[2:])[triple]
    keys = np.sort(np.concatenate([two, three]))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


RUN = "partition bigint, n int, width int, run binary"


def _path_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def run_rows(columns: list[np.ndarray], partitions: int) -> pa.RecordBatch:
    """A sorted run (columns: three word numbers and the count) cut by prefix partition, a row for each."""
    part = (_path_hash(columns[:3]) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    width = 4 if max(int(c.max()) for c in columns) < 1 << 31 else 8
    columns = [c[order].astype(f"<i{width}") for c in columns]
    pack = zstandard.ZstdCompressor(level=1).compress
    ends = np.append(starts[1:], len(part))
    runs = [pack(b"".join(c[a:z].tobytes() for c in columns)) for a, z in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(np.full(len(starts), width, np.int32)), pa.array(runs, pa.binary())], names=["partition", "n", "width", "run"])


def merged(runs: list[tuple[int, int, bytes]], min_count: int) -> pa.RecordBatch:
    """(w1, w2, w3, a) of a prefix partition's runs (n, width, bytes): phrases with min_count occurrences or more, w3 = 0 for two words."""
    read = zstandard.ZstdDecompressor().decompress
    columns = [np.frombuffer(read(data), f"<i{width}").reshape(4, n) for n, width, data in runs]
    w1, w2, w3, a = (np.concatenate([c[k] for c in columns]).astype(np.int64) for k in range(4))
    # The stable sort finds the runs and merges them.
    small = max(int(w1.max()), int(w2.max()), int(w3.max())) < 1 << BITS
    order = np.argsort((w1 << (2 * BITS)) | (w2 << BITS) | w3, kind="stable") if small else np.lexsort((w3, w2, w1))
    w1, w2, w3, a = w1[order], w2[order], w3[order], a[order]
    at = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])))
    total = np.add.reduceat(a, at)
    at, total = at[total >= min_count], total[total >= min_count]
    return pa.RecordBatch.from_arrays([pa.array(w1[at]), pa.array(w2[at]), pa.array(w3[at]), pa.array(total)], names=["w1", "w2", "w3", "a"])


def phrase_counts(chunks: DataFrame, numbers: DataFrame, n_words: int, p: PhraseParams) -> DataFrame:
    """w1, w2, w3 (0 for none), a: phrases of two and three words with min_count occurrences or more. chunks: as word_chunks gives, with chunk."""
    partitions = max(1, -(-2 * n_words // p.partition_entries))
    each = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    known = each.join(numbers.select("lang", "word", "rank"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("rank").alias("rank"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, at, rank in zip(b.column("ids"), b.column("at"), b.column("rank"), strict=True):
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids.as_py()), np.int32)
                at, rank = np.asarray(at.values, np.int64), np.asarray(rank.values, np.int64)
                # Within the chunk words get short numbers in the order of the corpus-wide ones, so that runs are sorted by these.
                order = np.argsort(rank)
                rank, short = np.append(0, rank[order]), np.zeros(max(int(np.abs(ids).max()), int(at.max()) + 1) + 1, np.int64)
                short[at[order] + 1] = np.arange(1, len(rank))
                counted, ids = ids > 0, short[np.abs(ids)]
                trie, mask = HatTrie(p.container_entries), (1 << BITS) - 1

                def runs(left: int, trie: HatTrie = trie, rank: np.ndarray = rank, mask: int = mask) -> Iterator[pa.RecordBatch]:
                    for keys, counts in trie.spill(left):
                        yield run_rows([rank[keys >> (2 * BITS)], rank[(keys >> BITS) & mask], rank[keys & mask], counts], partitions)

                step = 1 << 18
                for k in range(0, len(ids), step):
                    # Two words of the step before, whose own phrases are counted there.
                    lo = max(0, k - 2)
                    fresh = counted[lo : k + step].copy()
                    fresh[: k - lo] = False
                    trie.add(*phrases_of(ids[lo : k + step], fresh))
                    if trie.used > p.trie_entries:
                        yield from runs(p.trie_entries // 2)
                yield from runs(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for this, *run in zip(*(b.column(c).to_pylist() for c in ("partition", "n", "width", "run")), strict=True):
                if this != part and held:
                    yield merged(held, p.min_count)
                    held = []
                part = this
                held.append(tuple(run))
        if held:
            yield merged(held, p.min_count)

    runs = chunks.select("chunk", "ids").join(known, "chunk").select("ids", "at", "rank").mapInArrow(count, RUN)
    return runs.repartition("partition").sortWithinPartitions("partition").mapInArrow(merge, "w1 bigint, w2 bigint, w3 bigint, a bigint")


def _score(left: str, right: str) -> Column:
    d = lambda c: f"cast({c} as decimal(14,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * {d('a')} * {d('a')} div ({d(left)} * {d(right)})")


def scored_phrases(grams: DataFrame, numbers: DataFrame, p: PhraseParams) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    n = numbers.count()

    def word(k: int) -> DataFrame:
        return broadcast_if_small(numbers.select(F.col("rank").alias(f"w{k}"), F.col("word").cast("string").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])), n, p.max_broadcast_words)

    two, three = grams.filter("w3 = 0").drop("w3"), grams.filter("w3 > 0")
    covers = three.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("pair"), "a").groupBy("pair.w1", "pair.w2").agg(F.max("a").alias("longer"))
    free = two.join(covers, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < p.cover_percent * F.col("a"), F.lit(True)))
    pairs = free.join(word(1), "w1").join(word(2), "w2").select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))
    # Parts of a candidate are as frequent as it is, so that they are among the pairs.
    parts = three.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    known = parts.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3").withColumn("s1", _score("f1", "f23")).withColumn("s2", _score("f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    triples = known.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    chunks = written(word_chunks(docs.select("lang", "text"), p).withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    numbers = written(word_numbers(chunks, p), "phrase-words")
    grams = written(phrase_counts(chunks, numbers, n_words, p), "phrase-counts")
    found = scored_phrases(grams, numbers, p).withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of 64 parts of a language, then the first of these: a window sees 64 times `top` rows at most.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= p.top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= p.top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
