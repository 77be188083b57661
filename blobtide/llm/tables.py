"""Shared pieces of the operators in this package: table reading, stored steps, text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide.scratch import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written below spark.checkpoint.dir and read back, so later steps do not run it again."""
    return materialize(df, label)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as bigint `doc_id`) and `text`; other columns, whatever their names, are left out."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )


def in_train(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether a label may be learned: crc32 of the id as text does not fall into the held-out fold."""
    return fold(doc_id, folds) != held_out


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join where null keys match each other; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


# A key list of at most so many rows (about 100 MB in memory) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id and text are not among `dropped` (doc_id, text_hash). Null ids match each other."""
    keys = stored(dropped.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct(), "dropped")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = docs["doc_id"].cast("bigint").eqNullSafe(keys["_gone_id"]) & (F.xxhash64(docs["text"]) == keys["_gone_hash"])
    return docs.join(keys, same, "left_anti")
