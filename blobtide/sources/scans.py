"""Scans of the event tables: time window, row filter and column list of each input.

Every scan is a plain filter and projection, so on Parquet both reach the reader. `as_of` is the
upper end of the "last n days" window; it defaults to the current time. Of a table that is laid out
by day (`files.write_days`) only the days of the window are opened.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.functions.columns import fill_percentage, list_length
from blobtide.operators.bloom import prefilter
from blobtide.operators.joins import splittable_join
from blobtide.operators.rows import latest_per_key
from blobtide.scratch import materialize
from blobtide.sources.files import EVENT_DATE, EVENT_TIME

SIDECAR_COLUMNS = [
    "slot",
    "slot_start_date_time",
    "block_root",
    "kzg_commitment",
    "meta_network_name",
    "blob_index",
    "versioned_hash",
    "blob_size",
    "blob_empty_size",
]
TX_COLUMNS = [
    "hash",
    "block_number",
    "extra_data",
    "base_fee_per_gas",
    "gas_used",
    "effective_gas_price",
    "max_priority_fee_per_gas",
]


def newer_than(moment: Column, as_of: datetime | None, n_days: int) -> Column:
    """`moment` lies within the last `n_days` days before `as_of`.

    The bound is a literal when `as_of` is given, so the reader can skip row groups by it.
    """
    return moment > _bound(as_of, n_days)


def _bound(as_of: datetime | None, n_days: int) -> Column:
    if as_of is None:
        return F.localtimestamp() - F.make_dt_interval(F.lit(n_days))
    return F.lit(as_of - timedelta(days=n_days)).cast("timestamp_ntz")


def recent(raw: DataFrame, as_of: datetime | None, n_days: int) -> Column:
    """The events of `raw` in the window. In a table laid out by day the day is bounded as well.

    The second bound follows from the first, since a day folder holds the events of its own day.
    """
    inside = newer_than(F.col(EVENT_TIME), as_of, n_days)
    if EVENT_DATE not in raw.columns:
        return inside
    return inside & (F.col(EVENT_DATE) >= _bound(as_of, n_days).cast("date"))


def scan_mempool(
    raw: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 28,
    tx_type: int = 3,
    network: str | None = None,
    senders: list[str] | None = None,
) -> DataFrame:
    """Mempool sightings of blob transactions, with list length and fill percentage."""
    rows = raw.where(
        recent(raw, as_of, n_days) & (F.col("type") == tx_type)
    )
    if network is not None:
        rows = rows.where(F.col("meta_network_name") == network)
    if senders is not None:
        rows = rows.where(F.col("from").isin(senders))
    return rows.select(
        "event_date_time",
        "type",
        "blob_sidecars_size",
        "blob_sidecars_empty_size",
        "hash",
        "to",
        "from",
        "blob_hashes",
        "nonce",
        "meta_network_name",
        list_length(F.col("blob_hashes")).alias("blob_hashes_length"),
        fill_percentage(
            F.col("blob_sidecars_empty_size"), F.col("blob_sidecars_size")
        ).alias("fill_percentage"),
        "blob_gas",
        "blob_gas_fee_cap",
        "gas_price",
        "gas_tip_cap",
        "gas_fee_cap",
    )


def scan_canonical_sidecar(
    raw: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 28,
    network: str | None = None,
    with_client: bool = False,
) -> DataFrame:
    """Canonical blob sidecars.

    `with_client` gives the propagation form: the consensus client in place of the network.
    """
    rows = raw.where(recent(raw, as_of, n_days))
    if network is not None:
        rows = rows.where(F.col("meta_network_name") == network)
    scope = "meta_consensus_implementation" if with_client else "meta_network_name"
    return rows.select(
        *[scope if c == "meta_network_name" else c for c in SIDECAR_COLUMNS]
    )


def scan_block_events(
    raw: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 1,
    network: str = "mainnet",
) -> DataFrame:
    """Block sightings by the observing nodes."""
    return raw.where(
        recent(raw, as_of, n_days)
        & (F.col("meta_network_name") == network)
    ).select(
        "event_date_time",
        "slot",
        "slot_start_date_time",
        "propagation_slot_start_diff",
        "block",
        "epoch",
        "meta_network_name",
        "meta_consensus_implementation",
    )


def scan_canonical_block(
    raw: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 1,
    network: str = "mainnet",
    keys: tuple[str, ...] = ("slot",),
    version: str = "version",
) -> DataFrame:
    """Canonical blocks, latest version per key, with `block_root` named `block`.

    `keys` tell the blocks of one network apart. The latest of all versions counts, whenever it was
    seen; only then is the window applied. A block whose latest version is older than the window is
    left out, also if an earlier version lies in it. Finding the latest versions reads keys and
    versions of the whole table; all other columns are only read within the window.
    """
    columns = [
        "slot",
        "slot_start_date_time",
        F.col("block_root").alias("block"),
        "block_total_bytes_compressed",
        "execution_payload_transactions_total_bytes_compressed",
        "meta_consensus_implementation",
    ]
    blocks = raw.where(F.col("meta_network_name") == network)
    latest = latest_per_key(blocks, list(keys), version)
    return latest.where(recent(raw, as_of, n_days)).select(*columns)


def scan_sidecar_events(
    raw: DataFrame,
    as_of: datetime | None = None,
    n_days: int = 1,
    network: str = "mainnet",
) -> DataFrame:
    """Blob sidecar sightings, the input of the propagation spread."""
    return raw.where(
        recent(raw, as_of, n_days)
        & (F.col("meta_network_name") == network)
    ).select(
        "kzg_commitment",
        "slot",
        "meta_consensus_implementation",
        "slot_start_date_time",
        "event_date_time",
        "blob_index",
    )


def scan_txs(txs: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Transaction fees, kept to the transactions in `hashes` (a frame with a `hash` column).

    Many hashes are stored and made into a Bloom filter, which drops most other transactions before
    the join shuffles them.
    """
    rows = txs.select(*TX_COLUMNS)
    if hashes is None:
        return rows
    wanted = materialize(hashes.select("hash").distinct(), "hashes")
    return splittable_join(prefilter(rows, wanted, "hash"), wanted, ["hash"], "left_semi")
