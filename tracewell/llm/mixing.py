"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are packed, document after document, into blocks of a fixed number of words. The mix is a
list of slots. Each output shard draws its source counts from a multinomial; the counts are then scaled per source to
the slots its target asks for. Slot t of a source takes block permutation(t mod blocks), where the permutation is
pseudorandom, keyed by source and pass, so that no block is used again before all others were. Slots and documents
meet in a join on (source, block). Rows that a few sources explode into look few to the planner, which would broadcast
them; joins of such rows ask for a merge join.

Defined cases: a null text has no words; a null source is a source of its own and sorts last; documents without words
take part with `taken` 0; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, broadcast_if_small, words, written

#: Fixed values of the integer hash: a prime modulus and multipliers below it.
PRIME, MULT_A, MULT_C = 2147483647, 48271, 69621
#: Each source's documents are laid out in so many runs, so that a source with a third of all rows is not one sort.
RUNS = 1024
MAX_BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    max_repeats: int = 2
    block_words: int = 64
    shard_blocks: int = 8192
    seed: int = 20240607


def _mix(x: Column) -> Column:
    """A pseudorandom number below PRIME from one below PRIME."""
    y = (x * MULT_A + 12345) % PRIME
    return (y * y + x) % PRIME


def _source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of the text, which tells rows of one doc_id apart."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def source_targets(sized: DataFrame, p: MixParams) -> DataFrame:
    """One row per source: key, rank, source_size, target. Targets share the budget by weight and stop at max_repeats times the source; with sources ordered by size per weight, the first k that stop are found from running sums."""
    by_size = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    cycle = F.array(*[F.lit(w) for w in p.weights])
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(p.weights)).cast("int")).cast("double"))
    )
    before = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everywhere = Window.partitionBy()
    level = (
        ranked.withColumn("cap", F.col("source_size") * float(p.max_repeats))
        .withColumn("left", F.lit(p.share) * F.sum("source_size").over(everywhere) - (F.sum("cap").over(before) - F.col("cap")))
        .withColumn("left_weight", F.sum("weight").over(everywhere) - (F.sum("weight").over(before) - F.col("weight")))
        .withColumn("level", F.col("left") / F.col("left_weight"))
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_size), "level")))
        .withColumn("level", F.coalesce(F.min("open").over(everywhere)["level"], F.lit(float("inf"))))
    )
    return level.select("source", _source_key().alias("key"), "rank", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def pack(sized: DataFrame) -> DataFrame:
    """Adds key and start, the number of the source's words before the document. Running sums are taken in RUNS pieces per source and then over the pieces."""
    run = ((F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(PRIME)) * MULT_A) % PRIME % RUNS).alias("run")
    rows = sized.select("*", _source_key().alias("key"), run)
    in_run = Window.partitionBy("key", "run").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_runs = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("run_size")).select("key", "run", (F.sum("run_size").over(over_runs) - F.col("run_size")).alias("run_start"))
    placed = rows.withColumn("in_run", F.sum("size").over(in_run) - F.col("size"))
    return placed.join(runs.hint("merge"), ["key", "run"]).withColumn("start", F.col("run_start") + F.col("in_run")).drop("run", "run_start", "in_run")


def slot_counts(sources: DataFrame, p: MixParams) -> DataFrame:
    """Adds per source: words to take, blocks, whole blocks, slots, words of the last slot."""
    size, n = F.col("source_size"), F.lit(p.block_words)
    return (
        sources.withColumn("take", F.floor(F.col("target") + 0.5))
        .withColumn("whole", F.floor(size / n))
        .withColumn("blocks", F.ceil(size / n))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("take") / size)).otherwise(0))
        .withColumn("rest", F.col("take") - F.col("passes") * size)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / n))
        .withColumn("last_words", F.when(F.col("rest") > 0, F.col("rest") - (F.ceil(F.col("rest") / n) - 1) * n))
    )


def shard_draws(sources: DataFrame, p: MixParams) -> DataFrame:
    """For each source and shard the range [low, high) of the source's slots. The multinomial draw of a slot is a look-up of a pseudorandom number among the cumulative slot shares, by cells of equal width."""
    spark = sources.sparkSession
    row = sources.agg(F.sum("slots").alias("n"), F.count("*").alias("m")).first()
    total, cells = int(row["n"] or 0), 4 * max(1, row["m"])
    shards = max(1, -(-total // p.shard_blocks))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = (
        sources.filter("slots > 0").withColumn("upper", F.sum("slots").over(upto)).withColumn("lower", F.col("upper") - F.col("slots"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * cells / F.lit(max(1, total))), F.least(F.floor(F.col("upper") * cells / F.lit(max(1, total))), F.lit(cells - 1)))))
        .select("key", "lower", "upper", "cell")
    )
    number = _mix((_mix(F.col("id") % PRIME) + F.floor(F.col("id") / PRIME) * MULT_C + p.seed) % PRIME)
    point = F.floor(number.cast("double") / float(PRIME) * float(total)).alias("point")
    draws = spark.range(total).select(F.floor(F.col("id") / p.shard_blocks).alias("shard"), point)
    drawn = draws.withColumn("cell", F.floor(F.col("point") * cells / F.lit(max(1, total)))).join(broadcast_if_small(bounds, row["m"], MAX_BROADCAST_SOURCES), "cell").filter("point >= lower and point < upper")
    counts = drawn.groupBy("key", "shard").agg(F.count("*").alias("n"))
    upto_shard = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_shards = Window.partitionBy("key")
    scaled = (
        counts.withColumn("upper", F.sum("n").over(upto_shard)).withColumn("all", F.sum("n").over(all_shards))
        .join(sources.select("key", "slots"), "key")
        .select("key", "shard", F.expr("cast((upper - n) * cast(slots as decimal(19,0)) div all as bigint)").alias("low"), F.expr("cast(upper * cast(slots as decimal(19,0)) div all as bigint)").alias("high"))
    )
    missed = sources.filter("slots > 0").join(counts.select("key").distinct(), "key", "left_anti").select("key", (F.col("rank") % shards).alias("shard"), F.lit(0).cast("long").alias("low"), F.col("slots").alias("high"))
    return scaled.unionByName(missed).filter("high > low")


def permutations(sources: DataFrame, p: MixParams) -> DataFrame:
    """key, pass, at, block: for each source and pass the blocks of full length in a pseudorandom order, at = 0, 1, ... A block's place is the rank of its hash, found in runs of hashes and then over the runs."""
    n_tasks, piece = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096
    passes = sources.filter("whole > 0 and slots > 0").select("key", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("slots") / F.col("blocks")) - 1)).alias("pass"))
    # Pieces are listed in two steps, each dealt to all tasks: a source of 10^13 words has some 10,000 spans of 4,096 pieces, and no row lists more than that.
    spans = passes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / (piece * piece)))).alias("span")).repartition(n_tasks, "key", "pass", "span")
    last_piece = F.floor((F.col("whole") - 1) / piece)
    pieces = spans.select("key", "pass", "whole", F.explode(F.sequence(F.col("span") * piece, F.least(last_piece, (F.col("span") + 1) * piece - 1))).alias("piece")).repartition(n_tasks, "key", "pass", "piece")
    # As many runs as a run has blocks, roughly: both grow as the root of the source's blocks (2^10 runs at least, 2^20 at most).
    bits = F.greatest(F.lit(10), F.least(F.lit(20), F.ceil(F.log2("whole") / 2))).cast("int")
    blocks = pieces.select("key", "pass", bits.alias("bits"), F.explode(F.sequence(F.col("piece") * piece, F.least(F.col("whole"), (F.col("piece") + 1) * piece) - 1)).alias("block"))
    hashed = blocks.withColumn("h", F.xxhash64("key", "pass", "block", F.lit(p.seed))).withColumn("run", F.expr("shiftrightunsigned(h, 64 - bits)")).drop("bits")
    over_runs = Window.partitionBy("key", "pass").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = hashed.groupBy("key", "pass", "run").agg(F.count("*").alias("n")).select("key", "pass", "run", (F.sum("n").over(over_runs) - F.col("n")).alias("base"))
    in_run = hashed.withColumn("rn", F.row_number().over(Window.partitionBy("key", "pass", "run").orderBy("h", "block")))
    return in_run.join(runs.hint("merge"), ["key", "pass", "run"]).select("key", "pass", (F.col("base") + F.col("rn") - 1).alias("at"), "block")


def slots(sources: DataFrame, p: MixParams) -> DataFrame:
    """The mix: key, shard, slot, pass, block, and how many words of the block (from its first) the slot takes."""
    # An explicit number: few rows come in here, but many go out.
    n_tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = shard_draws(sources, p).repartition(n_tasks, "key", "shard")
    each = draws.select("key", "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("slot"))
    few = sources.select("key", "rank", "source_size", "whole", "blocks", "slots", "last_words")
    each = each.join(broadcast_if_small(few, few.count(), MAX_BROADCAST_SOURCES), "key")
    each = each.withColumn("at", F.col("slot") % F.col("blocks")).withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
    # Full blocks by permutation; the short block at a source's end comes last in each pass.
    short = each.filter("at >= whole").withColumn("block", F.col("at"))
    each = each.filter("at < whole").join(permutations(sources, p).hint("merge"), ["key", "pass", "at"]).select(*short.columns).unionByName(short)
    full = F.when(F.col("block") < F.col("whole"), F.lit(p.block_words)).otherwise(F.col("source_size") - F.col("whole") * p.block_words)
    last = (F.col("slot") == F.col("slots") - 1) & F.col("last_words").isNotNull()
    return each.select("key", "shard", "slot", "pass", "block", F.when(last, F.col("last_words")).otherwise(full).alias("n_words"))


def _pieces(packed: DataFrame, p: MixParams) -> DataFrame:
    """A row for each block that a document has words in, with the piece [first, last) of the block that is its own."""
    n = p.block_words
    last = F.floor((F.col("start") + F.col("size") - 1) / n)
    return (
        packed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / n), last)))
        .withColumn("first", F.greatest(F.col("start") - F.col("block") * n, F.lit(0)))
        .withColumn("last", F.least(F.col("start") + F.col("size") - F.col("block") * n, F.lit(n)))
    )


def plan_mix(docs: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents packed into blocks, sources with targets, slots), each a written table."""
    sized = written(sized_documents(docs), "mix-sized")
    sources = written(slot_counts(source_targets(sized, p), p), "mix-sources")
    packed = written(pack(sized), "mix-packed")
    return packed, sources, slots(sources, p)


def taken_words(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken."""
    packed, sources, mix = plan_mix(docs, p)
    uses = mix.groupBy("key", "block").agg(
        F.count(F.when(F.col("n_words") == p.block_words, 1)).alias("whole_uses"), F.collect_list(F.when(F.col("n_words") < p.block_words, F.col("n_words"))).alias("cut")
    )
    cut = F.aggregate("cut", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.least(F.col("last"), w) - F.col("first"), F.lit(0)))
    taken = (
        _pieces(packed, p).join(uses.hint("merge"), ["key", "block"])
        .select("key", "start", "doc_id", "size", "text_hash", (F.col("whole_uses") * (F.col("last") - F.col("first")) + cut).alias("taken"))
        .unionByName(packed.select("key", "start", "doc_id", "size", "text_hash", F.lit(0).cast("long").alias("taken")))
    )
    # Rows of the same document, source and start are one document, unless they have no words: those are kept as they are.
    with_words = taken.filter("size > 0").groupBy("key", "start", "doc_id", "size", "text_hash").agg(F.sum("taken").alias("taken")).drop("start", "text_hash")
    without = packed.filter("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    few = sources.select("key", "source_size", "target")
    return with_words.unionByName(without).join(broadcast_if_small(few, few.count(), MAX_BROADCAST_SOURCES), "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix as documents: for each pass over a source, a row for each document with the words that this pass takes (verbatim, with the white space after each word; a document taken whole keeps its text as it is). Columns as in docs; n_chars, where there is one, follows the text."""
    packed, _, mix = plan_mix(docs, p)
    run = F.struct((F.col("block") * p.block_words + F.col("first") - F.col("start")).alias("from"), (F.least("last", "n_words") - F.col("first")).alias("n"))
    takes = (
        _pieces(packed, p).join(mix.select("key", "block", "pass", "n_words").hint("merge"), ["key", "block"]).filter("n_words > first")
        .groupBy("key", "start", "doc_id", "size", "text_hash", "pass").agg(F.sort_array(F.collect_list(run)).alias("runs"))
        .groupBy("key", "start", "doc_id", "size", "text_hash").agg(F.sort_array(F.collect_list(F.struct("pass", "runs"))).alias("passes"))
    )
    # Rows alike in id, text and source are numbered on both sides and meet one to one.
    takes = takes.withColumn("copy", F.row_number().over(Window.partitionBy("key", "doc_id", "text_hash").orderBy("start")))
    kept = [c for c in docs.columns]
    rows = docs.select(F.struct(*kept).alias("row"), F.xxhash64("text").alias("hash")).withColumn("source_key", _source_key("row.source"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("source_key", F.col("row.doc_id"), "hash").orderBy(F.lit(1))))
    joined = rows.join(takes, (F.col("source_key") == F.col("key")) & F.col("row.doc_id").eqNullSafe(takes["doc_id"]) & (rows["hash"] == takes["text_hash"]) & (rows["copy"] == takes["copy"]))
    each = joined.select("row", "size", F.explode("passes").alias("turn")).select("row", "size", F.col("turn.runs").alias("runs"))
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]) == F.col("size")
    # Used twice, so that Spark computes the array once a row and not once for each run.
    each = each.withColumn("tokens", F.when(~whole, F.regexp_extract_all(F.col("row.text"), F.lit(f"[^{ASCII_SPACE}]+[{ASCII_SPACE}]*"), F.lit(0))))
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("tokens", (r["from"] + 1).cast("int"), r["n"].cast("int")))), "")
    each = each.withColumn("new_text", F.when(F.col("tokens").isNull(), F.col("row.text")).otherwise(cut))
    out = [F.col("new_text").alias("text") if c == "text" else F.length("new_text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col("row")[c].alias(c) for c in kept]
    return each.select(*out)
