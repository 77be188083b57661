"""Scalar expressions over Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_SLOT = 12
WEI_PER_GWEI = 1e9
WEI_PER_ETH = 1e18


def list_length(items: Column) -> Column:
    return F.size(items).cast("bigint")


def fill_percentage(empty: Column, size: Column) -> Column:
    """Share of a sidecar's bytes in use, in percent; NULL for a zero-sized sidecar."""
    return F.round(100 - F.try_divide(empty, size) * 100, 2)


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds from `start` to `end`, with microsecond resolution."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def milliseconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def slots_between(seconds: Column, seconds_per_slot: int = SECONDS_PER_SLOT) -> Column:
    """Slots waited, rounded up. A sighting after the slot counts by its distance."""
    return F.ceil(F.abs(seconds / F.lit(float(seconds_per_slot)))).cast("double")


def joined_list(items: Column) -> Column:
    """A list of hashes as one comma-separated string."""
    return F.array_join(items, ",")


def gwei(wei: Column) -> Column:
    return wei / F.lit(WEI_PER_GWEI)


def eth(wei: Column) -> Column:
    return wei / F.lit(WEI_PER_ETH)


def hex_to_text(value: Column) -> Column:
    """Latin-1 text of a 0x-prefixed hex string.

    Odd-length or non-hex input gives `invalid_hex`; NULL stays NULL.
    """
    digits = F.substring(value, 3, 2**31 - 1)
    valid = digits.rlike("^([0-9a-fA-F]{2})*$")
    # unhex only sees valid digits, whichever branch is evaluated
    text = F.decode(F.unhex(F.when(valid, digits)), "ISO-8859-1")
    return F.when(value.isNotNull(), F.when(valid, text).otherwise("invalid_hex"))


def builder_label(extra_data: Column) -> Column:
    """Name of the block builder: client builds are grouped, other texts are kept."""
    text = hex_to_text(extra_data)
    # Marker text in extra_data -> label; the first match wins.
    return (
        F.when(text.contains("geth"), "vanilla_builder_geth")
        .when(text.contains("reth"), "vanilla_builder_reth")
        .when(text.contains("rsync"), "rsync_builder")
        .otherwise(text)
    )


def fee_columns() -> dict[str, Column]:
    """Fee breakdown, each expression reading the raw wei columns of a transaction."""
    base, gas = F.col("base_fee_per_gas"), F.col("gas_used")
    paid, bid = F.col("effective_gas_price"), F.col("max_priority_fee_per_gas")
    base_fee = eth(base * gas)
    priority_fee = eth((paid - base) * gas)
    return {
        "base_tx_fee_eth": base_fee,
        "priority_tx_fee_eth": priority_fee,
        "total_tx_fee_eth": base_fee + priority_fee,
        "base_fee_per_gas": gwei(base),
        "priority_fee_gas": gwei(paid - base),
        "effective_gas_price_gwei": gwei(paid),
        "priority_fee_bid_percent_premium": F.round(F.try_divide(bid, paid), 3),
    }


def mean_timestamp(moment: Column) -> Column:
    """Mean of timestamps, truncated to the microsecond; the sum is kept exactly."""
    micros = F.unix_micros(moment.cast("timestamp"))
    total = F.sum(micros.cast("decimal(20,0)"))
    mean = F.call_function("div", total, F.nullif(F.count(micros), F.lit(0)))
    return F.timestamp_micros(mean).cast("timestamp_ntz")
