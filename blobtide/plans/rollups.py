"""Block, rollup and builder roll-ups of the joined inclusion and fee table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.operators.grouping import group_with_text
from blobtide.operators.ordered import cumulative_sum
from blobtide.operators.rows import drop_null_rows

FEES_COLLECTED = "priority fees collected (eth)"


def _distinct_complete(joined: DataFrame) -> DataFrame:
    return drop_null_rows(joined).distinct()


def blob_block(joined: DataFrame, ordered: bool = False) -> DataFrame:
    """Per (block, rollup): fee sums, mean inclusion and gas, and number of blobs."""
    blocks = group_with_text(
        _distinct_complete(joined),
        ["block_number", "sequencer_names"],
        "extra_data",
        {
            "slot_time": ("min", "slot_time"),
            "base_fees_per_block_eth": ("sum", "base_tx_fee_eth"),
            "priority_fees_per_block_eth": ("sum", "priority_tx_fee_eth"),
            "total_tx_fees_per_block_eth": ("sum", "total_tx_fee_eth"),
            "avg_slot_inclusion_rate_per_block": ("avg", "slot_inclusion_rate"),
            "avg_priority_fee_gas_per_block_gwei": ("avg", "priority_fee_gas"),
            "base_fee_per_gas": ("avg", "base_fee_per_gas"),
            "blobs_per_block": ("sum", "blob_hashes_length"),
        },
    )
    return blocks.orderBy("block_number", "sequencer_names") if ordered else blocks


def block_agg(blob_blocks: DataFrame, ordered: bool = False) -> DataFrame:
    """Per slot time, over all rollups. Means are unweighted means of the rollups' means.

    `blob_blocks`, from `blob_block`, reads a stored table; it is read twice.
    """
    sums = [
        "base_fees_per_block_eth",
        "priority_fees_per_block_eth",
        "total_tx_fees_per_block_eth",
    ]
    means = [
        "avg_slot_inclusion_rate_per_block",
        "avg_priority_fee_gas_per_block_gwei",
        "base_fee_per_gas",
    ]
    blocks = group_with_text(
        blob_blocks,
        ["slot_time"],
        "extra_data",
        {
            "block_number": ("min", "block_number"),
            **{c: ("sum", c) for c in sums},
            **{c: ("avg", c) for c in means},
            "blobs_per_block": ("sum", "blobs_per_block"),
        },
        stored=True,
    )
    return blocks.orderBy("block_number", "slot_time") if ordered else blocks


def cumulative_fees(block_aggs: DataFrame) -> DataFrame:
    """Base and priority fees added up over slot time."""
    return cumulative_sum(
        block_aggs,
        ["slot_time"],
        {
            "base_fees_per_block_eth": "base fee",
            "priority_fees_per_block_eth": "priority fee",
        },
    )


def rollup_macro(joined: DataFrame) -> DataFrame:
    """Per rollup: mean inclusion, blobs and fees."""
    return (
        _distinct_complete(joined)
        .groupBy(F.col("sequencer_names").alias("rollup"))
        .agg(
            F.avg("fill_percentage").alias("avg_fill_percentage"),
            F.avg("submission_count").alias("avg_submission_count"),
            F.round(F.avg("slot_inclusion_rate"), 3).alias("avg_slot_inclusion_rate"),
            F.avg("blob_hashes_length").alias("avg_blobs_in_tx"),
            F.count(F.lit(1)).alias("tx_count"),
            F.sum("blob_hashes_length").alias("blob_count"),
            F.round(F.sum("base_tx_fee_eth"), 3).alias("total_base_fees_eth"),
            F.round(F.sum("priority_tx_fee_eth"), 3).alias("total_priority_fees_eth"),
            F.round(F.sum("total_tx_fee_eth"), 3).alias("total_eth_fees"),
            F.round(F.avg("priority_fee_gas"), 3).alias("avg_priority_fee_bid"),
        )
    )


def rollup_summary(macro: DataFrame) -> DataFrame:
    return macro.select(
        "rollup", "avg_blobs_in_tx", "blob_count", "tx_count", "total_eth_fees"
    ).orderBy(F.col("avg_blobs_in_tx").desc_nulls_first(), "rollup")


def builder_table(
    joined: DataFrame,
    exclude: str = "base",
    min_rows: int = 100,
    dedupe: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Per block builder with more than `min_rows` rows, one rollup left out.

    A transaction counts once per blob row, as in the joined table; `dedupe` counts equal rows
    once.
    """
    rows = joined.where(
        (F.col("sequencer_names") != exclude) & F.col("builder_label").isNotNull()
    )
    if dedupe:
        rows = rows.distinct()
    table = (
        rows.groupBy("builder_label")
        .agg(
            F.round(F.avg("slot_inclusion_rate"), 3).alias("slot_inclusion_rate"),
            F.round(F.sum("priority_tx_fee_eth"), 3).alias(FEES_COLLECTED),
            F.round(F.avg("blob_hashes_length"), 3).alias("blob_hashes_length"),
            F.count(F.lit(1)).alias("blob_tx_count"),
            F.countDistinct("block_number").alias("block_count"),
        )
        .where(F.col("blob_tx_count") > min_rows)
    )
    slowest_first = F.col("slot_inclusion_rate").desc_nulls_first()
    return table.orderBy(slowest_first, "builder_label") if ordered else table


def top_builders(builders: DataFrame, k: int = 10) -> DataFrame:
    """The `k` builders with the most blob rows."""
    return (
        builders.select(
            "builder_label",
            "slot_inclusion_rate",
            "block_count",
            "blob_tx_count",
            "blob_hashes_length",
            FEES_COLLECTED,
        )
        .orderBy(F.col("blob_tx_count").desc(), "builder_label")
        .limit(k)
    )
