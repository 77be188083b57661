"""From mempool sightings to slot inclusion.

A blob waits from its first sighting in the mempool until the slot that carries it. Sightings are
collapsed to transactions, blob lists are taken apart, and every blob is matched with its
canonical sidecar by versioned hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import SECONDS_PER_SLOT, seconds_between, slots_between
from blobtide.operators.ordered import ROWS_PER_BLOCK, after_first, rolling_mean, with_row_id
from blobtide.operators.rows import complete, explode_list, outlier_filter, sort_rows
from blobtide.scratch import materialize

MEAN_COLUMNS = [
    "blob_hashes_length",
    "blob_sidecars_size",
    "fill_percentage",
    "blob_gas",
    "blob_gas_fee_cap",
    "gas_price",
    "gas_tip_cap",
    "gas_fee_cap",
]
SIDECAR_JOIN_COLUMNS = [
    "versioned_hash",
    "slot",
    "slot_start_date_time",
    "block_root",
    "kzg_commitment",
    "meta_network_name",
    "blob_size",
    "blob_empty_size",
]
# The columns of the inclusion table, in order.
INCLUSION_COLUMNS = [
    "versioned_hash",
    "nonce",
    "event_date_time_min",
    "event_date_time_max",
    "blob_hashes_length",
    "blob_sidecars_size",
    "fill_percentage",
    "blob_gas",
    "blob_gas_fee_cap",
    "gas_price",
    "gas_tip_cap",
    "gas_fee_cap",
    "hash",
    "from",
    "to",
    "submission_count",
    "slot",
    "slot_time",
    "block_root",
    "kzg_commitment",
    "meta_network_name",
    "blob_size",
    "blob_empty_size",
    "beacon_inclusion_time",
    "slot_inclusion_rate",
    "slot_inclusion_rate_50_blob_avg",
    "2_slot_target_inclusion_rate",
]
# What the joined table needs of the inclusion table.
JOINED_SOURCE_COLUMNS = [
    "slot",
    "slot_time",
    "hash",
    "from",
    "fill_percentage",
    "submission_count",
    "slot_inclusion_rate",
    "meta_network_name",
    "blob_hashes_length",
]
# Order of blobs: slot time, then what tells the blobs of one slot apart, then a hash of the rest.
INCLUSION_ORDER = ["slot_time", "versioned_hash", "nonce", "meta_network_name"]
_TIE = "_tie"
_TIE_COLUMNS = [
    "block_root",
    "kzg_commitment",
    "slot",
    "hash",
    "from",
    "to",
    "event_date_time_min",
    "event_date_time_max",
    "submission_count",
    "blob_size",
    "blob_empty_size",
]
ROLLING_BLOBS = 50


def _sightings_per_tx(mempool: DataFrame) -> DataFrame:
    """One row per (blob list, nonce, hash, from, to) with sums and counts.

    Text columns are keys here, not aggregates, so this pass over all sightings is a hash
    aggregate with map-side combine.
    """
    keys = [F.col("blob_hashes").alias("versioned_hash"), "nonce", "hash", "from", "to"]
    return mempool.groupBy(*keys).agg(
        F.min("event_date_time").alias("event_date_time_min"),
        F.max("event_date_time").alias("event_date_time_max"),
        *[F.expr(f"sum(CAST({c} AS DOUBLE)) AS _sum_{c}") for c in MEAN_COLUMNS],
        *[F.expr(f"count({c}) AS _n_{c}") for c in MEAN_COLUMNS],
    )


def mempool_by_tx(mempool: DataFrame) -> DataFrame:
    """Sightings collapsed per (blob list, hash, from, to, nonce)."""
    return _sightings_per_tx(mempool).select(
        "versioned_hash",
        "hash",
        "from",
        "to",
        "nonce",
        "event_date_time_min",
        "event_date_time_max",
        *[F.expr(f"try_divide(_sum_{c}, _n_{c}) AS {c}") for c in MEAN_COLUMNS],
    )


def mempool_by_nonce(mempool: DataFrame) -> DataFrame:
    """Sightings collapsed per (blob list, nonce), with the transaction seen last.

    Of transactions last seen at the same time the greatest (hash, from, to) is taken.
    """
    last = F.max(F.struct("event_date_time_max", "hash", "from", "to")).alias("_last")
    collapsed = (
        _sightings_per_tx(mempool)
        .groupBy("versioned_hash", "nonce")
        .agg(
            F.min("event_date_time_min").alias("event_date_time_min"),
            last,
            *[
                F.expr(f"try_divide(sum(_sum_{c}), sum(_n_{c})) AS {c}")
                for c in MEAN_COLUMNS
            ],
        )
    )
    return collapsed.select(
        "versioned_hash",
        "nonce",
        "event_date_time_min",
        F.col("_last.event_date_time_max").alias("event_date_time_max"),
        *MEAN_COLUMNS,
        F.col("_last.hash").alias("hash"),
        F.col("_last.from").alias("from"),
        F.col("_last.to").alias("to"),
    )


def submission_count(collapsed: DataFrame) -> DataFrame:
    """Add how many rows share each row's blob list.

    Counts are aggregated and joined back: a window over the list would put all rows of an
    often repeated list into one task. `collapsed` is read twice, so pass a stored frame when
    it is costly.
    """
    counts = collapsed.groupBy(F.col("versioned_hash").alias("_list")).agg(
        F.count(F.lit(1)).alias("submission_count")
    )
    # A missing list is a key of its own. The null-safe comparison also gives the counts a
    # shuffle of their own, without which a skewed list could not be split (see joins.py).
    same_list = F.col("versioned_hash").eqNullSafe(F.col("_list"))
    return collapsed.join(counts, same_list).drop("_list")


def explode_blobs(collapsed: DataFrame) -> DataFrame:
    """One row per blob of each list; an empty list gives one row without a hash."""
    return explode_list(collapsed, "versioned_hash")


def mempool_sidecar_join(
    exploded: DataFrame, sidecar: DataFrame, how: str = "left"
) -> DataFrame:
    """Join blobs with canonical sidecars on `versioned_hash`, as distinct rows.

    A versioned hash may have several sidecars; each gives a row. Both sides are made distinct
    first, which makes the result distinct: copies collapse before they can multiply, and no
    shuffle is needed above the join. Rows without a hash match nothing, so they are spread
    over the tasks by their transaction instead of all meeting in one.
    """
    blobs = exploded.distinct()
    sidecars = sidecar.select(*SIDECAR_JOIN_COLUMNS).distinct()
    if how == "inner":
        return blobs.join(sidecars, "versioned_hash")
    by_tx = F.concat(F.lit("none-"), F.xxhash64("hash", "nonce").cast("string"))
    return (
        blobs.withColumn("_key", F.coalesce("versioned_hash", by_tx))
        .join(sidecars.withColumnRenamed("versioned_hash", "_key"), "_key", how)
        .drop("_key")
    )


def inclusion_time(
    df: DataFrame, rate: str = "num_slot_inclusion", seconds_per_slot: int = SECONDS_PER_SLOT
) -> DataFrame:
    """Add seconds and whole slots from first sighting to slot start.

    The seconds are negative for a blob first seen after its slot; the slots never are.
    """
    seconds = seconds_between(F.col("event_date_time_min"), F.col("slot_start_date_time"))
    return df.withColumn("beacon_inclusion_time", seconds).withColumn(
        rate, slots_between(F.col("beacon_inclusion_time"), seconds_per_slot)
    )


def rolling_inclusion(
    df: DataFrame, n: int = ROLLING_BLOBS, block_rows: int = ROWS_PER_BLOCK, ordered: bool = False
) -> DataFrame:
    """Add the mean slot inclusion of the last `n` blobs, NULL until there are `n`."""
    tied = df if _TIE in df.columns else df.withColumn(_TIE, F.xxhash64(*_TIE_COLUMNS))
    return rolling_mean(
        tied,
        [*INCLUSION_ORDER, _TIE],
        {"slot_inclusion_rate": "slot_inclusion_rate_50_blob_avg"},
        n=n,
        block_rows=block_rows,
        ordered=ordered,
    ).drop(_TIE)


def _timed_blobs(mempool: DataFrame, sidecar: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blobs with a canonical slot: `columns`, what their order needs, and whether the row is complete.

    Blobs without a canonical sidecar have no slot: they come first in slot order with no value to
    average and are dropped in the end, so they are left out from the start, like empty blob lists.
    """
    with_blobs = mempool.where(F.size("blob_hashes") > 0)
    collapsed = materialize(mempool_by_nonce(with_blobs), "collapsed")
    blobs = explode_blobs(submission_count(collapsed))
    in_slots = sidecar.where(F.col("slot_start_date_time").isNotNull())
    matched = mempool_sidecar_join(blobs, in_slots, how="inner")
    timed = inclusion_time(matched, "slot_inclusion_rate").withColumnRenamed(
        "slot_start_date_time", "slot_time"
    )
    # completeness is noted, so that the columns that nobody wants need not be stored for it
    flagged = timed.withColumns(
        {"_complete": complete(timed.columns), _TIE: F.xxhash64(*_TIE_COLUMNS)}
    )
    wanted = [c for c in columns if c in timed.columns]
    needed = dict.fromkeys([*wanted, *INCLUSION_ORDER, "slot_inclusion_rate", "_complete", _TIE])
    return flagged.select(*needed)


def _kept(blobs: DataFrame, network: str, max_rate: float) -> DataFrame:
    complete_rows = blobs.where(F.col("_complete") & (F.col("meta_network_name") == network))
    return outlier_filter(complete_rows, "slot_inclusion_rate", max_rate)


def slot_inclusion(
    mempool: DataFrame,
    sidecar: DataFrame,
    network: str = "mainnet",
    max_rate: float = 200,
    ordered: bool = False,
    columns: Sequence[str] = INCLUSION_COLUMNS,
) -> DataFrame:
    """Per blob: time and slots from first sighting to canonical slot (27 columns, or those wanted).

    The rolling mean covers all networks and outliers; they are filtered out after it.
    `submission_count` counts the nonces that carried the same blob list.
    With `ordered` the result is sorted by slot time.
    """
    timed = _timed_blobs(mempool, sidecar, columns)
    rolled = rolling_inclusion(timed, ordered=ordered).withColumn(
        "2_slot_target_inclusion_rate", F.lit(2)
    )
    kept = rolled.where(F.col("slot_inclusion_rate_50_blob_avg").isNotNull())
    return _kept(kept, network, max_rate).select(*columns)


def included_blobs(
    mempool: DataFrame,
    sidecar: DataFrame,
    network: str = "mainnet",
    max_rate: float = 200,
    columns: Sequence[str] = JOINED_SOURCE_COLUMNS,
) -> DataFrame:
    """The rows of `slot_inclusion` without its rolling mean, stored.

    The mean only decides which rows are left out: those with fewer than 50 rates up to them. If
    every blob has a rate these are the first 49, which a top-k finds. A blob without a rate, seen
    at no time, takes the mean from the 49 after it as well; then the mean is needed.
    """
    rows = with_row_id(_timed_blobs(mempool, sidecar, columns))
    if rows.where(F.col("slot_inclusion_rate").isNull()).isEmpty():
        kept = after_first(rows, [*INCLUSION_ORDER, _TIE], ROLLING_BLOBS - 1)
    else:
        rolled = rolling_inclusion(rows)
        kept = rolled.where(F.col("slot_inclusion_rate_50_blob_avg").isNotNull())
    return _kept(kept, network, max_rate).select(*columns)


def process_rollup(
    mempool: DataFrame,
    sidecar: DataFrame,
    rollup: str,
    network: str = "mainnet",
    ordered: bool = False,
) -> DataFrame:
    """Inclusion per transaction and blob of one sender, blobs without a slot included.

    Here `submission_count` counts the transactions that carried the same blob list.
    With `ordered` the result is sorted by slot.
    """
    sent = mempool.where(
        (F.col("from") == rollup) & (F.col("meta_network_name") == network)
    )
    collapsed = materialize(mempool_by_tx(sent), "rollup")
    blobs = explode_blobs(submission_count(collapsed)).drop("event_date_time_max")
    result = inclusion_time(mempool_sidecar_join(blobs, sidecar), "num_block_inclusion")
    return sort_rows(result, F.col("slot")) if ordered else result
