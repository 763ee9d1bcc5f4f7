"""Bloom filter of hashes that may occur more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**26 bits.  The broadcast table has at most 2**BITS / 64 rows of 16 bytes
# (16 MB), whatever the number of hashes.
BITS = 26


def _positions(h: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def repeated_filter(hashes: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """First pass: the words (``word``, ``bits``) of a Bloom filter in which a bit is
    set if at least two rows fall on it.

    Positions are counted with partial aggregation, so a hash that a third of all
    rows share leaves each task once.  A hash that occurs twice has both of its
    bits set; a hash that occurs once has them set only by collision."""
    if not 6 < bits <= 31:
        raise ValueError("bits must lie between 7 and 31")
    places = hashes.select(F.explode(F.array(*_positions(F.col(col), bits))).alias("place"))
    return _words(places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def filter_of(hashes: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """The words of a Bloom filter of all hashes in the column."""
    if not 6 < bits <= 31:
        raise ValueError("bits must lie between 7 and 31")
    return _words(hashes.select(F.explode(F.array(*_positions(F.col(col), bits))).alias("place")))


def _words(places: DataFrame) -> DataFrame:
    return (places.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63L AS INT))")).alias("bits")))


def maybe_in(rows: DataFrame, col: str, filter_words: DataFrame, out: str = "_maybe",
                   bits: int = BITS) -> DataFrame:
    """Second pass: add a boolean that is false only for hashes the filter was not
    given.  Both probes are joins with the broadcast filter words; the rows are not
    shuffled."""
    tests = []
    for i, place in enumerate(_positions(F.col(col), bits)):
        words = F.broadcast(filter_words.select(F.col("word").alias(f"_w{i}"), F.col("bits").alias(f"_b{i}")))
        rows = rows.withColumn(f"_p{i}", place)
        rows = rows.join(words, F.shiftright(f"_p{i}", 6) == F.col(f"_w{i}"), "left")
        tests.append(F.coalesce(F.expr(f"(shiftright(_b{i}, CAST(_p{i} & 63L AS INT)) & 1L) = 1L"), F.lit(False)))
    return rows.withColumn(out, tests[0] & tests[1]).drop("_p0", "_w0", "_b0", "_p1", "_w1", "_b1")
