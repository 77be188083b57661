"""All dashboard tables of one batch refresh, with the shared tables stored once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from blobtide.plans import charts, fees, rollups
from blobtide.scratch import materialize, scope, settled
from blobtide.sources.files import write_cached
from blobtide.sources.inputs import Inputs


def dashboard(
    inputs: Inputs, names: Sequence[str], network: str = "mainnet"
) -> dict[str, DataFrame]:
    """Tables and chart data for the chosen rollups, by name.

    The joined, filtered and per-block tables feed several results each and are stored. The
    builder tables cover all rollups but the excluded one. What the joined table is made from is
    deleted once it is stored; the stored tables belong to the caller's scratch scope.
    """
    spark = inputs.mempool.sparkSession
    joined = settled(spark, lambda: fees.joined_from_inputs(inputs, network), "joined")
    filtered = materialize(fees.filter_by_sequencer(joined, names, network), "filtered")
    blocks = materialize(rollups.block_agg(rollups.blob_block(filtered)), "blocks")
    medians = fees.slot_gas_groupby(filtered)
    macro = rollups.rollup_macro(filtered)
    builders = rollups.builder_table(joined)
    return {
        "inclusion_line": charts.inclusion_line_data(filtered, names),
        "premium_scatter": charts.premium_scatter_data(filtered, names),
        "premium_line": charts.premium_line_data(medians, names),
        "fee_gwei": charts.fee_gwei_long(filtered, names),
        "fee_eth": charts.fee_eth_long(filtered, names),
        "fees_vs_inclusion": charts.fees_vs_inclusion(blocks),
        "cumulative_fees": rollups.cumulative_fees(blocks),
        "rollup_macro": macro,
        "rollup_summary": rollups.rollup_summary(macro),
        "builders": builders,
        "top_builders": rollups.top_builders(builders),
        "inclusion_table": charts.inclusion_table(filtered, names),
    }


def refresh(
    inputs: Inputs, names: Sequence[str], folder: str, network: str = "mainnet"
) -> list[str]:
    """Write all dashboard tables below `folder`, replacing older ones, and leave no scratch behind."""
    with scope(inputs.mempool.sparkSession):
        tables = dashboard(inputs, names, network)
        for name, table in tables.items():
            write_cached(table, f"{folder.rstrip('/')}/{name}", mode="overwrite")
    return list(tables)
