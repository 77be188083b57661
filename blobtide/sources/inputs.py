"""The bundle of input frames behind the dashboard pipelines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide import schemas
from blobtide.sources.dimensions import sequencer_dim
from blobtide.sources.files import read_cached, read_days
from blobtide.sources.scans import scan_canonical_sidecar, scan_mempool, scan_txs

MEMPOOL_TABLE = "mempool_transaction"
SIDECAR_TABLE = "canonical_beacon_blob_sidecar"
TX_TABLE = "txs"


@dataclass(frozen=True)
class Inputs:
    """The input frames. `txs` may hold more transactions than the mempool."""

    mempool: DataFrame
    sidecar: DataFrame
    txs: DataFrame
    sequencers: DataFrame

    def seen_txs(self) -> DataFrame:
        """Transactions seen in the mempool scan. Joins on included blobs need no such filter first."""
        return scan_txs(self.txs, self.mempool)

    def counts(self) -> DataFrame:
        """Row count per table, as (table_name, row_count)."""
        parts = [
            frame.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, frame in {**vars(self), "txs": self.seen_txs()}.items()
        ]
        return reduce(DataFrame.unionByName, parts)


def load_inputs(
    spark: SparkSession,
    directory: str,
    as_of: datetime | None = None,
    period: int = 7,
    network: str = "mainnet",
    producers: dict[str, list[str]] | None = None,
) -> Inputs:
    """Read the Parquet tables of `directory` for one period and network.

    Event tables laid out by day (`files.write_days`) are only opened for the days of the period.
    With `producers` (a rollup mapping) only their transactions are kept. Fees are those of all
    transactions; what joins them asks for its own (`seen_txs`, `fees.joined_from_inputs`).
    """

    folder = directory.rstrip("/")
    mempool = scan_mempool(
        read_days(spark, f"{folder}/{MEMPOOL_TABLE}", schemas.MEMPOOL_TRANSACTION),
        as_of,
        period,
        network=network,
        senders=None if producers is None else producers["sequencer_addresses"],
    )
    sidecar = scan_canonical_sidecar(
        read_days(spark, f"{folder}/{SIDECAR_TABLE}", schemas.CANONICAL_SIDECAR),
        as_of,
        period,
        network=network,
    )
    txs = scan_txs(read_cached(spark, f"{folder}/{TX_TABLE}", schemas.TRANSACTIONS))
    return Inputs(mempool, sidecar, txs, sequencer_dim(spark, producers))
