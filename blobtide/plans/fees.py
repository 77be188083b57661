"""Transaction fees, priority-fee bids and block builders, per included blob."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import builder_label as label_of
from blobtide.functions.columns import fee_columns
from blobtide.operators.bloom import prefilter
from blobtide.operators.joins import null_safe_join, splittable_join
from blobtide.operators.rows import drop_null_rows, outlier_filter, sort_rows
from blobtide.operators.selection import group_quantiles
from blobtide.scratch import materialize
from blobtide.sources.inputs import Inputs
from blobtide.sources.scans import scan_txs
from blobtide.plans.inclusion import included_blobs

# The columns of the bid table and of the joined table, in order.
GAS_BIDDING_COLUMNS = [
    "block_number",
    "extra_data",
    "builder_label",
    "base_tx_fee_eth",
    "priority_tx_fee_eth",
    "total_tx_fee_eth",
    "base_fee_per_gas",
    "priority_fee_gas",
    "meta_network_name",
    "priority_fee_bid_percent_premium",
    "slot_inclusion_rate",
    "submission_count",
    "hash",
    "from",
]
JOINED_INCLUSION_COLUMNS = [
    "slot",
    "slot_time",
    "hash",
    "fill_percentage",
    "submission_count",
    "slot_inclusion_rate",
    "sequencer_names",
    "meta_network_name",
    "blob_hashes_length",
]
JOINED_FEE_COLUMNS = [
    "block_number",
    "extra_data",
    "builder_label",
    "hash",
    "base_tx_fee_eth",
    "priority_tx_fee_eth",
    "base_fee_per_gas",
    "priority_fee_gas",
    "total_tx_fee_eth",
    "priority_fee_bid_percent_premium",
]


def fee_breakdown(incl_with_txs: DataFrame) -> DataFrame:
    """Add the fee columns; `base_fee_per_gas` turns from wei into gwei."""
    return incl_with_txs.withColumns(fee_columns())


def builder_label(df: DataFrame, column: str = "extra_data") -> DataFrame:
    return df.withColumn("builder_label", label_of(F.col(column)))


def _bids(
    incl: DataFrame, txs: DataFrame, columns: Sequence[str], network: str
) -> DataFrame:
    """Distinct bid rows without NULLs.

    The blobs of one transaction are reduced to distinct rows before the join, so a transaction
    with many rows does not weigh on it. Rows without a fee record would be dropped as NULL
    rows, hence the inner join. Transactions of no included blob are dropped before the shuffle.
    """
    blobs = incl.where(F.col("meta_network_name") == network).select(
        "hash", "from", "meta_network_name", "slot_inclusion_rate", "submission_count"
    )
    fee_rows = prefilter(scan_txs(txs), blobs, "hash").distinct()
    paid = splittable_join(blobs.distinct(), fee_rows, ["hash"])
    return drop_null_rows(
        builder_label(fee_breakdown(paid)).select(*columns).distinct()
    )


def slot_gas_bidding(
    incl: DataFrame, txs: DataFrame, network: str = "mainnet", ordered: bool = False
) -> DataFrame:
    """Fees, bid premium and builder per transaction and inclusion rate (14 columns)."""
    result = _bids(incl, txs, GAS_BIDDING_COLUMNS, network)
    return sort_rows(result, F.col("block_number")) if ordered else result


def _median_and_mean(
    df: DataFrame, keys: Sequence[str], median_of: str, mean_of: str
) -> DataFrame:
    """Exact median of one column and mean of another per group.

    Rows are counted per (group, value) first; the counts are stored, since the selection of the
    median reads them a few times. No task holds the values of a group.
    """
    counted = materialize(
        df.groupBy(*keys, F.col(median_of).alias("value")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(mean_of).alias("_sum"),
            F.count(mean_of).alias("_n_mean"),
        ),
        "counts",
    )
    means = counted.groupBy(*keys).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n_mean")).alias(mean_of)
    )
    values = counted.where("value IS NOT NULL").select(*keys, "value", "n")
    medians = group_quantiles(values, keys, {median_of: 0.5}).drop("n_values")
    return null_safe_join(means, medians, keys, "left").select(*keys, median_of, mean_of)


def bid_premium(
    incl: DataFrame, txs: DataFrame, max_rate: float = 50, network: str = "mainnet"
) -> DataFrame:
    """Median bid premium and mean gas price paid (gwei) per inclusion rate."""
    bids = _bids(incl, txs, [*GAS_BIDDING_COLUMNS, "effective_gas_price_gwei"], network)
    medians = _median_and_mean(
        bids,
        ["slot_inclusion_rate"],
        "priority_fee_bid_percent_premium",
        "effective_gas_price_gwei",
    )
    return outlier_filter(
        drop_null_rows(medians), "slot_inclusion_rate", max_rate
    ).orderBy("slot_inclusion_rate")


def inclusion_with_rollup(
    incl: DataFrame, dim: DataFrame, case_insensitive: bool = False
) -> DataFrame:
    """Add the rollup name of the sender; NULL for unknown senders.

    Addresses are compared as written (checksummed) unless `case_insensitive`. There is no
    broadcast hint: a small dimension is broadcast by its size, a large one is shuffled.
    """
    sender, address = F.col("from"), F.col("sequencer_addresses")
    if case_insensitive:
        sender, address = F.lower(sender), F.lower(address)
    return incl.join(dim, sender == address, "left").drop("sequencer_addresses")


def inclusion_joined(
    incl: DataFrame, txs: DataFrame, dim: DataFrame, network: str = "mainnet"
) -> DataFrame:
    """Inclusion with rollup name and fees, joined on the transaction hash.

    `incl` is read twice; pass a stored frame. A transaction with several bid rows gives a row
    for each, as equal rows are only removed by the aggregates above.
    """
    blobs = inclusion_with_rollup(incl, dim).select(*JOINED_INCLUSION_COLUMNS)
    bids = slot_gas_bidding(incl, txs, network).select(*JOINED_FEE_COLUMNS)
    return splittable_join(blobs, bids, ["hash"], "left")


def joined_from_inputs(inputs: Inputs, network: str = "mainnet") -> DataFrame:
    """The joined table straight from the inputs, with the included blobs stored once."""
    incl = included_blobs(inputs.mempool, inputs.sidecar, network)
    return inclusion_joined(incl, inputs.txs, inputs.sequencers, network)


def filter_by_sequencer(
    joined: DataFrame, names: Sequence[str], network: str = "mainnet", ordered: bool = False
) -> DataFrame:
    """Distinct rows of the chosen rollups on one network."""
    result = joined.where(
        F.col("sequencer_names").isin(list(names)) & (F.col("meta_network_name") == network)
    ).distinct()
    return sort_rows(result, F.col("slot")) if ordered else result


def slot_gas_groupby(filtered: DataFrame, ordered: bool = False) -> DataFrame:
    """Median bid premium and mean base fee per (inclusion rate, rollup)."""
    medians = _median_and_mean(
        filtered,
        ["slot_inclusion_rate", "sequencer_names"],
        "priority_fee_bid_percent_premium",
        "base_fee_per_gas",
    )
    groups = drop_null_rows(medians)
    return groups.orderBy("slot_inclusion_rate", "sequencer_names") if ordered else groups
