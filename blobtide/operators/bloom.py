"""A Bloom filter in DataFrame functions, tested below the shuffle of a join.

The rows of a large table that cannot match a set of keys are dropped where they are scanned, before they
are shuffled. A key that is in the set always passes; about one other in fifty does too, so the join
still follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.scratch import materialize

BITS_PER_KEY = 8
HASHES = 5
# 8 MB of bits, gathered in one row: a larger set of keys is not filtered for.
MOST_BITS = 1 << 26
# Spark broadcasts fewer keys, and then the large side is not shuffled at all.
LEAST_KEYS = 100_000


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), key).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def bloom_bits(keys: DataFrame, column: str, n_keys: int) -> tuple[DataFrame, int] | None:
    """One row `bits`, an array of 64-bit words, and their number of bits; None if there are too many keys."""
    bits = 1 << max(10, (n_keys * BITS_PER_KEY - 1).bit_length())
    if bits > MOST_BITS:
        return None
    spots = keys.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("at"))
    words = spots.select(
        F.shiftright("at", 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("mask"),
    )
    every = keys.sparkSession.range(bits // 64).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask")
    )
    merged = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    row = merged.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return row.select(F.transform("words", lambda w: w["mask"]).alias("bits")), bits


def might_contain(row: DataFrame, bits: int, key: Column) -> Column:
    """Whether all bits of the key are set; NULL is in no set."""
    words = row.scalar()
    seen = key.isNotNull()
    for at in _positions(key, bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        seen = seen & (F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return seen


def prefilter(
    rows: DataFrame, keys: DataFrame, column: str, least_keys: int = LEAST_KEYS
) -> DataFrame:
    """`rows` without most of those whose `column` is not in `keys`. Pass a stored `keys`: it is counted.

    Rows are filtered before any shuffle. The filter is sized from the number of distinct keys.
    """
    if keys.count() < least_keys:
        return rows
    distinct = materialize(
        keys.select(column).where(F.col(column).isNotNull()).distinct(), "bloom-keys"
    )
    found = bloom_bits(distinct, column, distinct.count())
    return rows if found is None else rows.where(might_contain(*found, F.col(column)))
