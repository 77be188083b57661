"""How often blob lists are resubmitted, and how bids change when they are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import gwei, joined_list, mean_timestamp
from blobtide.operators.joins import splittable_join
from blobtide.operators.rows import sort_rows
from blobtide.scratch import materialize


FEE_CAPS = ["gas_tip_cap", "gas_fee_cap", "blob_gas_fee_cap"]


def _with_joined_list(mempool: DataFrame) -> DataFrame:
    return mempool.withColumn("blob_hashes", joined_list(F.col("blob_hashes")))


def _most_repeated_first() -> list:
    return [F.col("count").desc(), F.col("event_date_time").asc(), F.col("blob_hashes").asc()]


def resubmission_window(
    mempool: DataFrame, start: datetime, end: datetime, min_count: int = 8
) -> DataFrame:
    """Blob lists seen more than `min_count` times strictly between two times."""
    moment = F.col("event_date_time")
    inside = (moment > F.lit(start).cast("timestamp_ntz")) & (
        moment < F.lit(end).cast("timestamp_ntz")
    )
    return (
        _with_joined_list(mempool.where(inside))
        .groupBy("blob_hashes")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > min_count)
        .orderBy(F.col("count").desc(), "blob_hashes")
    )


def resubmission_counts(mempool: DataFrame, ordered: bool = False) -> DataFrame:
    """Per blob list: sightings, first sighting and the nonce it carried then.

    Counted per (list, nonce) first, which leaves few rows for the second aggregate.
    """
    per_nonce = (
        _with_joined_list(mempool)
        .groupBy("blob_hashes", "nonce")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("event_date_time").alias("_seen"))
    )
    counts = (
        per_nonce.groupBy("blob_hashes")
        .agg(F.sum("_n").alias("count"), F.min(F.struct("_seen", "nonce")).alias("_first"))
        .select(
            "blob_hashes",
            "count",
            F.col("_first._seen").alias("event_date_time"),
            F.col("_first.nonce").alias("nonce"),
        )
    )
    return counts.orderBy(*_most_repeated_first()) if ordered else counts


def resubmission_series(counts: DataFrame, min_count: int = 8) -> DataFrame:
    """Lists seen more than `min_count` times, by first sighting."""
    return (
        counts.where(F.col("count") > min_count)
        .select("event_date_time", "count")
        .orderBy("event_date_time", "count")
    )


def worst_case_resubmission(
    mempool: DataFrame, counts: DataFrame, rank: int = 1, count: int | None = None
) -> DataFrame:
    """Per transaction profile of one blob list: the `rank`-th most repeated one.

    With `count`, ranks among the lists seen exactly that often. Ties go by first sighting.
    """
    candidates = counts if count is None else counts.where(F.col("count") == count)
    # a single row, so broadcasting it is safe at any input size
    chosen = (
        candidates.orderBy(*_most_repeated_first())
        .offset(rank - 1)
        .limit(1)
        .select("blob_hashes")
    )
    return (
        _with_joined_list(mempool)
        .join(F.broadcast(chosen), "blob_hashes", "left_semi")
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("count"),
            mean_timestamp(F.col("event_date_time")).alias("mean_event_date_time"),
            F.min(F.struct("event_date_time", "nonce")).alias("_first"),
            *[
                F.avg(gwei(F.col(c))).alias(c)
                for c in ("blob_gas_fee_cap", "gas_price", "gas_tip_cap", "gas_fee_cap")
            ],
        )
        .withColumn("nonce", F.col("_first.nonce"))
        .drop("_first")
        .orderBy("mean_event_date_time", "hash")
    )


def nonce_neighbourhood(counts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Blob lists whose first nonce lies strictly between `lo` and `hi`."""
    return counts.where((F.col("nonce") > lo) & (F.col("nonce") < hi)).orderBy(
        "nonce", "blob_hashes"
    )


def followup_by_nonce(mempool: DataFrame, counts: DataFrame, nonce: int) -> DataFrame:
    """All sightings of the blob list first seen under `nonce`, by time."""
    # usually one list; stored, so that its file size lets Spark broadcast it
    lists = materialize(counts.where(F.col("nonce") == nonce).select("blob_hashes"), "lists")
    sightings = splittable_join(
        _with_joined_list(mempool), lists, ["blob_hashes"], "left_semi"
    )
    return sort_rows(sightings, F.col("event_date_time"))


def submission_histogram(rollup_incl: DataFrame, divisor: float = 6) -> DataFrame:
    """Rows per submission count, divided by `divisor`."""
    return (
        rollup_incl.groupBy("submission_count")
        .agg((F.count(F.lit(1)) / F.lit(float(divisor))).alias("count"))
        .orderBy("count", "submission_count")
    )


def bid_range(rollup_incl: DataFrame) -> DataFrame:
    """Per (nonce, blob): spread of the fee caps that were bid, and mean inclusion."""
    spread = [
        f(c).alias(f"{side}_{c}")
        for c in FEE_CAPS
        for side, f in (("min", F.min), ("max", F.max))
    ]
    return rollup_incl.groupBy("nonce", "versioned_hash").agg(
        F.max("submission_count").alias("submission_count"),
        (F.max("gas_tip_cap") - F.min("gas_tip_cap")).alias("gas_tip_diff"),
        F.avg("num_block_inclusion").alias("num_block_inclusion"),
        *spread,
    )


def top_bid_range(rollup_incl: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most often submitted (nonce, blob) pairs."""
    return (
        bid_range(rollup_incl)
        .orderBy(
            F.col("submission_count").desc(),
            F.col("nonce").asc_nulls_first(),
            F.col("versioned_hash").asc_nulls_first(),
        )
        .limit(k)
    )


def bid_stats(rollup_incl: DataFrame) -> DataFrame:
    """Per submission count: how many blobs, their mean inclusion and fee-cap range (gwei)."""
    gas_range = gwei(F.col("max_gas_fee_cap") - F.col("min_gas_fee_cap"))
    return (
        bid_range(rollup_incl)
        .groupBy("submission_count")
        .agg(
            F.count(F.lit(1)).alias("agg_count"),
            F.round(F.avg("num_block_inclusion"), 3).alias("block inclusion mean"),
            F.round(F.avg(gas_range), 3).alias("gas_diff_mean"),
        )
        .orderBy("submission_count")
    )
