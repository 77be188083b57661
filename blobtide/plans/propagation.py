"""Block propagation: sighting delays against blob count, clients and missed slots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import milliseconds_between
from blobtide.operators.joins import splittable_join
from blobtide.operators.ordered import rolling_mean
from blobtide.operators.pivots import pivot_cells, pivot_columns, pivoted
from blobtide.operators.rows import fill_numeric_nulls, split_labels
from blobtide.sources.scans import scan_sidecar_events

# The usual consensus clients, and blobs per block in the first forks, for fixed columns.
CLIENTS = ("lighthouse", "prysm", "teku", "lodestar", "nimbus")
BLOB_COUNTS = (0, 1, 2, 3, 4, 5, 6)

CLIENT = "meta_consensus_implementation"
DELAY = "propagation_slot_start_diff"
# Columns of the most delayed sighting that stand for a (slot, client).
SIGHTING_COLUMNS = [
    "slot_start_date_time",
    "block",
    "epoch",
    "slot_start_date_time_canonical_block",
    "block_canonical_block",
]


def blob_sidecar_spread(
    sidecar_events: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 1,
    network: str = "mainnet",
) -> DataFrame:
    """Per (commitment, slot, client): first and last sighting and the time between them."""
    first, last = F.min("event_date_time"), F.max("event_date_time")
    return (
        scan_sidecar_events(sidecar_events, as_of, n_days, network)
        .groupBy("kzg_commitment", "slot", CLIENT)
        .agg(
            F.min("slot_start_date_time").alias("min_slot_start_date_time"),
            first.alias("first_event_time"),
            last.alias("last_event_time"),
            milliseconds_between(first, last).alias("time_diff_milliseconds"),
            F.max("blob_index").alias("max_blob_index"),
        )
    )


def block_sidecar_joined(
    block_events: DataFrame,
    canonical_block: DataFrame,
    spread: DataFrame,
    sidecar_client: DataFrame,
    max_diff_ms: int = 12500,
) -> DataFrame:
    """Block sightings with canonical block, sidecar spread and canonical sidecar.

    All joins are LEFT, so slots without blobs or without a canonical block stay. Numeric NULLs
    become -1 and the blob index is raised by one: 0 means no blobs. A canonical block is
    matched by slot only, a canonical sidecar by commitment and client.

    The canonical sidecar depends on the spread alone, so these two are joined first: joined
    last, every sighting without blobs would meet under one NULL commitment.
    """
    sightings = block_events.where(F.col(DELAY) < max_diff_ms)
    blocks = canonical_block.select(
        "slot",
        F.col("slot_start_date_time").alias("slot_start_date_time_canonical_block"),
        F.col("block").alias("block_canonical_block"),
        "block_total_bytes_compressed",
        "execution_payload_transactions_total_bytes_compressed",
        F.col(CLIENT).alias(f"{CLIENT}_canonical_block"),
    )
    sidecars = sidecar_client.select(
        "kzg_commitment",
        CLIENT,
        F.col("slot").alias("slot_canonical_blob"),
        F.col("slot_start_date_time").alias("slot_start_date_time_canonical_blob"),
        "block_root",
        "blob_index",
        "versioned_hash",
        "blob_size",
        "blob_empty_size",
    )
    # NULLs are filled and copies dropped on each side. A row then either matches or does not,
    # so the filled join is distinct as well and needs no shuffle above it. The slot is joined as
    # it came, in a column of its own: a NULL slot matches nothing and is -1 only in the result.
    sightings, blocks, seen_blobs = (
        fill_numeric_nulls(side.withColumn("_slot", F.col("slot")), keep=["_slot"])
        for side in (sightings, blocks, spread.drop("min_slot_start_date_time"))
    )
    sightings, blocks = sightings.distinct(), blocks.drop("slot").distinct()
    blobs = splittable_join(
        seen_blobs.drop("slot"),
        fill_numeric_nulls(sidecars).distinct(),
        ["kzg_commitment", CLIENT],
        "left",
    )
    seen = splittable_join(sightings, blocks, ["_slot"], "left")
    joined = splittable_join(seen, blobs, ["_slot", CLIENT], "left").drop("_slot")
    return fill_numeric_nulls(joined).withColumn(
        "max_blob_index", F.col("max_blob_index") + 1
    )


def block_blob_table(bsj: DataFrame, ordered: bool = False) -> DataFrame:
    """Per (blob count, client): rows, mean propagation (ms) and mean block size (KB)."""
    table = bsj.groupBy("max_blob_index", CLIENT).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(DELAY).alias("mean_propagation_slot_start_diff"),
        (F.avg("block_total_bytes_compressed") / 1000).alias("mean_block_size_compressed"),
    )
    slowest_first = F.col("mean_propagation_slot_start_diff").desc_nulls_first()
    return table.orderBy(slowest_first, "max_blob_index", CLIENT) if ordered else table


def propagation_pivot(table: DataFrame, clients: Sequence[str] | None = None) -> DataFrame:
    """Mean propagation in seconds: one row per blob count, one column per client.

    All clients found get a column; a given list must name every one of them.
    """
    seconds = F.max(F.col("mean_propagation_slot_start_diff") / 1000)
    cells = pivot_cells(table, ["max_blob_index"], CLIENT, seconds)
    wanted = pivot_columns(cells, CLIENT, clients)
    return pivoted(cells, ["max_blob_index"], CLIENT, wanted).orderBy("max_blob_index")


def slot_propagation(bsj: DataFrame) -> DataFrame:
    """Per (slot, blob count): slot start and mean propagation (ms)."""
    return bsj.groupBy("slot", "max_blob_index").agg(
        F.min("slot_start_date_time").alias("slot_start_date_time"),
        F.avg(DELAY).alias(DELAY),
    )


def _slot_cells(propagation: DataFrame) -> DataFrame:
    return pivot_cells(propagation, ["slot_start_date_time"], "max_blob_index", F.max(DELAY))


def _blob_columns(cells: DataFrame, blobs: Sequence[int]) -> DataFrame:
    return pivoted(
        cells, ["slot_start_date_time"], "max_blob_index", blobs, lambda n: f"blobs_{n}"
    )


def propagation_by_blobs(propagation: DataFrame, blobs: Sequence[int] | None = None) -> DataFrame:
    """One row per slot start, one column `blobs_<n>` of mean propagation per blob count.

    All blob counts found get a column; a given list must name every one of them.
    """
    cells = _slot_cells(propagation)
    return _blob_columns(cells, pivot_columns(cells, "max_blob_index", blobs))


def slow_one_blob_slots(
    propagation: DataFrame,
    blobs: int = 1,
    min_ms: float = 8000,
    columns: Sequence[int] | None = None,
) -> DataFrame:
    """Pivoted slots whose mean propagation at `blobs` blobs is above `min_ms`."""
    cells = _slot_cells(propagation)
    columns = pivot_columns(cells, "max_blob_index", columns)
    shown = columns if blobs in columns else sorted([*columns, blobs])
    return _blob_columns(cells, shown).where(F.col(f"blobs_{blobs}") > min_ms)


def rolling_propagation(
    propagation: DataFrame, blobs: Sequence[int] = (0, 1), n: int = 32
) -> DataFrame:
    """Mean propagation in seconds over the last `n` slots, per blob count.

    The window counts slots; slots without a value are skipped in the mean.
    """
    # a slot without any of the wanted blob counts is still a row of the window
    seconds = propagation.groupBy("slot_start_date_time").agg(
        *[
            (F.max(F.when(F.col("max_blob_index") == b, F.col(DELAY))) / 1000).alias(f"blobs_{b}")
            for b in blobs
        ]
    )
    return rolling_mean(
        seconds,
        ["slot_start_date_time"],
        {f"blobs_{b}": f"rolling_blobs_{b}" for b in blobs},
        n=n,
        min_periods=1,
    )


def _by_slot_and_client(bsj: DataFrame, max_slot: int | None) -> DataFrame:
    """Per (slot, client): the most delayed sighting, mean delay and largest blob count.

    Sightings with the same columns are reduced first by a hash aggregate. Of equal delays the
    greatest sighting in column order is taken.
    """
    rows = bsj if max_slot is None else bsj.where(F.col("slot") < max_slot)
    reduced = rows.groupBy("slot", CLIENT, *SIGHTING_COLUMNS).agg(
        F.max(DELAY).alias("_delay"),
        F.sum(DELAY).alias("_sum"),
        F.count(DELAY).alias("_n"),
        F.max("max_blob_index").alias("_blobs"),
    )
    latest = F.max(F.struct("_delay", *SIGHTING_COLUMNS)).alias("_latest")
    return reduced.groupBy("slot", CLIENT).agg(
        latest,
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"),
        F.max("_blobs").alias("blob_count"),
    )


def reorged_blocks(
    bsj: DataFrame, max_slot: int | None = None, ordered: bool = False
) -> DataFrame:
    """Per (slot, client): its most delayed sighting and the block's blob count.

    Slots from `max_slot` on are left out, for canonical data that lags behind. A NULL canonical
    block means the slot was missed.
    """
    table = _by_slot_and_client(bsj, max_slot).select(
        "slot",
        CLIENT,
        "_latest.slot_start_date_time",
        F.col("_latest._delay").alias(DELAY),
        *[f"_latest.{c}" for c in SIGHTING_COLUMNS[1:]],
        "blob_count",
    )
    if not ordered:
        return table
    return table.orderBy(F.col("block_canonical_block").desc_nulls_first(), "slot", CLIENT)


def reorged_blocks_labeled(
    bsj: DataFrame, max_slot: int | None = None, ordered: bool = False
) -> DataFrame:
    """Per (slot, client): mean delay in seconds, labelled by blobs and by reorg."""
    table = _by_slot_and_client(bsj, max_slot).select(
        "slot",
        CLIENT,
        "_latest.slot_start_date_time",
        (F.col("_mean") / 1000).alias(DELAY),
        *[f"_latest.{c}" for c in SIGHTING_COLUMNS[1:]],
        "blob_count",
    )
    labeled = table.withColumns(
        {
            "has_blobs": split_labels(F.col("blob_count") == 0, "no blobs", "blobs"),
            "reorged": split_labels(
                F.col("slot_start_date_time_canonical_block").isNull(), "reorged", "finalized"
            ),
        }
    )
    return labeled.orderBy(F.col("slot").desc(), CLIENT) if ordered else labeled


def split_reorged(blocks: DataFrame) -> DataFrame:
    """Both sides of the reorg split in one frame, told apart by the column `side`."""
    missed = F.col("slot_start_date_time_canonical_block").isNull()
    return blocks.withColumn("side", split_labels(missed, "reorged", "finalized"))


def _missed(blocks: DataFrame, since: datetime, keys: Sequence[str]) -> DataFrame:
    canonical = F.col("block_canonical_block")
    return (
        blocks.where(F.col("slot_start_date_time") > F.lit(since).cast("timestamp_ntz"))
        .groupBy(*keys)
        .agg(
            F.count_if(canonical.isNull()).alias("missed_blocks"),
            F.count_if(canonical.isNotNull()).alias("finalized_blocks"),
        )
        .orderBy(*keys)
    )


def missed_by_blob_count(blocks: DataFrame, since: datetime) -> DataFrame:
    """Missed and finalized blocks per blob count, for slots after `since`."""
    return _missed(blocks, since, ["blob_count"])


def missed_by_blob_client(blocks: DataFrame, since: datetime) -> DataFrame:
    """Missed and finalized blocks per blob count and client, for slots after `since`."""
    return _missed(blocks, since, ["blob_count", CLIENT])
