"""The data behind each chart. Drawing is left to the plotting tool of choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import gwei
from blobtide.operators.distributions import box_stats, density, density_2d, histogram
from blobtide.operators.rows import drop_null_rows, outlier_filter, sort_rows
from blobtide.plans.propagation import DELAY, split_reorged


def _of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("sequencer_names").isin(list(names)))


def inclusion_line_data(filtered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inclusion over time by rollup, with the target of two slots."""
    return _of(filtered, names).select(
        "slot_time",
        "slot_inclusion_rate",
        "submission_count",
        "sequencer_names",
        F.lit(2).alias("2_slot_target_inclusion_rate"),
    )


def premium_scatter_data(
    filtered: DataFrame, names: Sequence[str], max_rate: float = 100, ordered: bool = False
) -> DataFrame:
    """Bid premium against inclusion rate. With `ordered` only these columns are sorted."""
    rows = outlier_filter(_of(filtered, names), "slot_inclusion_rate", max_rate).select(
        "slot_inclusion_rate", "priority_fee_bid_percent_premium", "sequencer_names"
    )
    return sort_rows(rows, F.col("slot_inclusion_rate")) if ordered else rows


def premium_line_data(
    medians: DataFrame, names: Sequence[str], max_rate: float = 100
) -> DataFrame:
    """Median bid premium against inclusion rate."""
    return outlier_filter(_of(medians, names), "slot_inclusion_rate", max_rate).withColumnRenamed(
        "priority_fee_bid_percent_premium", "priority fee bid premium (%)"
    )


def _fees_long(
    filtered: DataFrame, names: Sequence[str], fees: Sequence[str]
) -> DataFrame:
    return _of(filtered, names).unpivot(
        ["slot_time", "sequencer_names"], list(fees), "fee", "amount"
    )


def fee_gwei_long(filtered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Base and priority fee per gas (gwei) over time, in long form."""
    return _fees_long(filtered, names, ["base_fee_per_gas", "priority_fee_gas"])


def fee_eth_long(filtered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Base and priority fee paid (ETH) over time, in long form."""
    return _fees_long(filtered, names, ["base_tx_fee_eth", "priority_tx_fee_eth"])


def fees_vs_inclusion(block_aggs: DataFrame) -> DataFrame:
    """Fees paid, inclusion rate and base fee over slot time."""
    return block_aggs.select(
        "slot_time",
        "total_tx_fees_per_block_eth",
        "avg_slot_inclusion_rate_per_block",
        "base_fee_per_gas",
    ).orderBy("slot_time")


def inclusion_table(filtered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Complete rows, slowest inclusion first."""
    rows = drop_null_rows(_of(filtered, names))
    return sort_rows(rows, F.col("slot_inclusion_rate").desc())


def rollup_inclusion_scatter(rollup_incl: DataFrame, ordered: bool = False) -> DataFrame:
    """Slots waited over slot time. With `ordered` only these columns are sorted."""
    rows = rollup_incl.select("slot_start_date_time", "num_block_inclusion")
    return sort_rows(rows, F.col("num_block_inclusion")) if ordered else rows


def propagation_histogram(blocks: DataFrame, bins: int = 100) -> DataFrame:
    """Propagation of missed and of finalized blocks, each over its own range."""
    return histogram(split_reorged(blocks).select("side", DELAY), DELAY, ["side"], bins)


def propagation_box_stats(labeled: DataFrame) -> DataFrame:
    """Box-and-whisker statistics of propagation per (has_blobs, reorged)."""
    return box_stats(labeled, DELAY, ["has_blobs", "reorged"])


def propagation_density(
    labeled: DataFrame, bandwidth: float | None = None, cells: int = 2048, grid: int = 512
) -> DataFrame:
    """Violin outline of propagation per (has_blobs, reorged)."""
    return density(labeled, DELAY, ["has_blobs", "reorged"], bandwidth, cells, grid)


def gas_cap_density(
    rollup_incl: DataFrame,
    bandwidths: Sequence[float] = (0.1, 1.0),
    cells: int = 256,
    grid: int = 100,
) -> DataFrame:
    """Joint density of the gas fee cap (gwei) and slots waited."""
    return density_2d(
        rollup_incl,
        gwei(F.col("gas_fee_cap")),
        F.col("num_block_inclusion"),
        bandwidths,
        cells,
        grid,
    )


def blob_gas_cap_density(
    rollup_incl: DataFrame,
    bandwidths: Sequence[float] = (0.1, 1.0),
    cells: int = 256,
    grid: int = 100,
) -> DataFrame:
    """Joint density of the blob gas fee cap (gwei) and slots waited."""
    return density_2d(
        rollup_incl,
        gwei(F.col("blob_gas_fee_cap")),
        F.col("num_block_inclusion"),
        bandwidths,
        cells,
        grid,
    )
