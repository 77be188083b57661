"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like `splittable_join`, with NULL keys matching each other; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    left = left.withColumn("_split", F.xxhash64(*keys))
    right = renamed.withColumn("_right_split", F.xxhash64(*[f"_right_{k}" for k in keys]))
    return left.join(right, same & (F.col("_split") == F.col("_right_split")), how).drop(
        "_split", "_right_split", *[f"_right_{k}" for k in keys]
    )


def splittable_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which adaptive execution can always split a skewed key.

    It only can when both inputs come straight from a shuffle. A side that was grouped by the
    join key is already partitioned by it and would be joined without one, so a hash of the keys
    joins along as a further key: no partitioning from below covers it. The grouped side, small
    by then, is shuffled once more; a side small enough is broadcast all the same.
    """
    hashed = F.xxhash64(*keys)
    return (
        left.withColumn("_split", hashed)
        .join(right.withColumn("_split", hashed), [*keys, "_split"], how)
        .drop("_split")
    )
