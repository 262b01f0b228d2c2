"""A hashed set of fixed size as one array of bits, for look-ups on the main path without a join. It may say yes to what isn't in the set, never no to what is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit


def _slots(h: Column, n_bits: int) -> list[Column]:
    """Three bit numbers from one hash, 0 to n_bits - 1, for up to 2^27 bits (a remainder would be negative where the hash is, as a shift by 0 keeps its sign)."""
    return [F.pmod(F.shiftrightunsigned(h, by), F.lit(n_bits)) for by in (0, 20, 37)]


def hashed_set(hashes: DataFrame, n_bits: int) -> DataFrame:
    """One row with an array<bigint> of n_bits bits, those of the hashes in column h set. Its size doesn't depend on the data."""
    slot = hashes.select(F.explode(F.array(*_slots(F.col("h"), n_bits))).alias("slot"))
    bits = slot.groupBy(F.floor(F.col("slot") / 64).alias("id")).agg(F.bit_or(bit(F.col("slot") % 64)).alias("bits"))
    every = hashes.sparkSession.range(n_bits // 64).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("word"))
    return every.agg(F.transform(F.sort_array(F.collect_list("word")), lambda x: x["bits"]).alias("bits"))


def in_set(bits: Column, h: Column, n_bits: int) -> Column:
    hit = F.lit(True)
    for slot in _slots(h, n_bits):
        hit = hit & (F.getbit(F.get(bits, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1)
    return hit
