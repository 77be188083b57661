"""Input tables derived from `events` by Spark SQL. All are deterministic functions of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from blobtide.sources.dimensions import ROLLUP_SEQUENCERS, sequencer_dim

# Senders 0xSEQ0..0xSEQ9 get the rollup names; 0xSEQ10 and 0xSEQ11 stay unknown.
SEQUENCER_MAPPING = {
    "sequencer_addresses": [f"0xSEQ{i}" for i in range(10)],
    "sequencer_names": ROLLUP_SEQUENCERS["sequencer_names"],
}

# What the derived sightings hold at every scale factor; the pivots must find it by themselves.
FOUND_CLIENTS = ["grandine", "lighthouse", "lodestar", "nimbus", "prysm", "teku"]
FOUND_BLOB_COUNTS = list(range(10))

BASE = """
SELECT event_id, ts, value, g, b, CASE WHEN b % 29 = 0 THEN 0 ELSE 1 + b % 6 END AS n
FROM (
  SELECT event_id, ts, value, g,
         CASE WHEN CAST((g - g % 2) / 2 AS BIGINT) % 4 = 0 THEN g - g % 2 ELSE g END AS b
  FROM (SELECT event_id, ts, value, CAST((event_id - event_id % 3) / 3 AS BIGINT) AS g
        FROM {events})
)
"""

MEMPOOL = """
SELECT event_id, ts AS event_date_time, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 3 END AS type,
       n * 131072 AS blob_sidecars_size,
       n * ((b * 3701) % 131072) AS blob_sidecars_empty_size,
       concat('0xtx', g, CASE WHEN g % 5 = 0 AND event_id % 3 = 2 THEN 'r1' ELSE 'r0' END) AS hash,
       concat('0xto', b % 12) AS `to`, concat('0xSEQ', b % 12) AS `from`,
       CASE WHEN n = 0 THEN CAST(array() AS ARRAY<STRING>)
            ELSE transform(sequence(0, CAST(n - 1 AS INT)), i -> concat('0x01-', b, '-', i))
       END AS blob_hashes,
       g AS nonce, CASE WHEN b % 9 = 0 THEN 'holesky' ELSE 'mainnet' END AS meta_network_name,
       CAST(n * 131072 AS DOUBLE) AS blob_gas,
       CAST((1 + b % 9) * 1000000000 AS DOUBLE) AS blob_gas_fee_cap,
       20000000000.0e0 + CAST(1 + event_id % 50 AS DOUBLE) * 1000000000 AS gas_price,
       CAST(1 + event_id % 4 AS DOUBLE) * 1000000000 AS gas_tip_cap,
       20000000000.0e0 + CAST(1 + event_id % 50 AS DOUBLE) * 1000000000 AS gas_fee_cap
FROM {base}
"""

BLOBSET = """
SELECT b, n,
       CAST(floor(sec / 12) AS BIGINT)
         + CASE WHEN b % 50 = 49 THEN 250 WHEN b % 19 = 0 THEN -60 ELSE 1 + b % 40 END AS slot
FROM (
  SELECT b, max(n) AS n,
         min(CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)) AS sec
  FROM {base} GROUP BY b
)
WHERE b % 13 <> 0
"""

SIDECAR = """
SELECT slot, CAST(timestamp_seconds(slot * 12) AS TIMESTAMP_NTZ) AS slot_start_date_time,
       CAST(timestamp_seconds(slot * 12 + 4) AS TIMESTAMP_NTZ) AS event_date_time,
       concat('0xblk', slot) AS block_root, concat('0xkzg', b, '-', i) AS kzg_commitment,
       net AS meta_network_name, i AS blob_index, concat('0x01-', b, '-', i) AS versioned_hash,
       CAST(131072 AS BIGINT) AS blob_size, (b * 3701) % 131072 AS blob_empty_size
FROM (
  SELECT b, n, slot, 'mainnet' AS net FROM {blobset} WHERE n > 0
  UNION ALL
  SELECT b, n, slot, 'holesky' FROM {blobset} WHERE b % 17 = 0 AND n > 0
) LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), CAST(n - 1 AS BIGINT))) u AS i
"""

TXS = """
SELECT hash, min(slot) + 1000000 AS block_number,
       CASE WHEN min(slot) % 31 = 0 THEN NULL WHEN min(slot) % 31 = 1 THEN '0xe974e9'
            ELSE concat('0x', lower(hex(
              CASE min(slot) % 5 WHEN 0 THEN 'geth go1.22' WHEN 1 THEN 'reth/v0.2.0'
                   WHEN 2 THEN 'rsync-builder.xyz' WHEN 3 THEN 'beaverbuild.org' ELSE 'Titan' END)))
       END AS extra_data,
       CAST(10000000000 + (min(slot) % 1000) * 1000000 AS DOUBLE) AS base_fee_per_gas,
       CAST(21000 * (1 + min(nonce) % 3) AS DOUBLE) AS gas_used,
       CAST(10000000000 + (min(slot) % 1000) * 1000000 + (1 + min(nonce) % 4) * 1000000000
            AS DOUBLE) AS effective_gas_price,
       CAST((1 + min(nonce) % 7) * 1000000000 AS DOUBLE) AS max_priority_fee_per_gas
FROM (SELECT concat('0xtx', f.g, CASE WHEN f.g % 5 = 0 AND f.event_id % 3 = 2
                                      THEN 'r1' ELSE 'r0' END) AS hash,
             f.g AS nonce, s.slot
      FROM {base} f JOIN {blobset} s ON f.b = s.b)
WHERE nonce % 23 <> 0
GROUP BY hash
"""

BLOCK_EVENT = """
SELECT CASE WHEN s % 41 = 7 THEN NULL ELSE s END AS slot,
       CAST(timestamp_seconds(1704067200 + s * 12) AS TIMESTAMP_NTZ) AS slot_start_date_time,
       CAST(timestamp_millis(CAST((1704067200 + s * 12) * 1000 + diff AS BIGINT))
            AS TIMESTAMP_NTZ) AS event_date_time,
       diff AS propagation_slot_start_diff, concat('0xb', s) AS block,
       CAST(floor(s / 32) AS BIGINT) AS epoch, 'mainnet' AS meta_network_name,
       client AS meta_consensus_implementation
FROM (
  SELECT event_id AS s, CAST(floor(value * 100) AS BIGINT) + c AS diff,
         CASE WHEN event_id % 37 = 0 THEN 'grandine' ELSE
         CASE (event_id + c) % 5 WHEN 0 THEN 'lighthouse' WHEN 1 THEN 'prysm' WHEN 2 THEN 'teku'
              WHEN 3 THEN 'lodestar' ELSE 'nimbus' END END AS client
  FROM {events} LATERAL VIEW explode(array(0, 1)) k AS c
)
"""

CANONICAL_BLOCK = """
SELECT CASE WHEN event_id % 43 = 5 THEN NULL ELSE event_id END AS slot,
       CAST(timestamp_seconds(1704067200 + event_id * 12) AS TIMESTAMP_NTZ)
         AS slot_start_date_time,
       concat('0xb', event_id) AS block_root,
       CAST(50000 + event_id % 1000 + 7 * v AS BIGINT) AS block_total_bytes_compressed,
       CAST(30000 + event_id % 700 AS BIGINT)
         AS execution_payload_transactions_total_bytes_compressed,
       'lighthouse' AS meta_consensus_implementation, 'mainnet' AS meta_network_name,
       CAST(timestamp_seconds(1704067200 + event_id * 12 + 12 - CASE WHEN v = 2 THEN 3456000 ELSE 0 END)
            AS TIMESTAMP_NTZ) AS event_date_time,
       CAST(v AS BIGINT) AS version
FROM {events} LATERAL VIEW explode(array(0, 1, 2)) k AS v
WHERE event_id % 10 <> 0
  AND (v = 0 OR v = 1 AND event_id % 6 = 0 OR v = 2 AND event_id % 22 = 4)
"""

SIDECAR_EVENT = """
SELECT concat('0xkzg', s, '-', i) AS kzg_commitment, slot,
       client AS meta_consensus_implementation, slot_start_date_time,
       CAST(timestamp_millis(CAST((1704067200 + s * 12) * 1000 + 1500 + 200 * i + 37 * obs
            AS BIGINT)) AS TIMESTAMP_NTZ) AS event_date_time,
       i AS blob_index, 'mainnet' AS meta_network_name
FROM (
  SELECT slot, slot_start_date_time, coalesce(slot, 0) AS s, meta_consensus_implementation AS client,
         CASE WHEN slot % 30 = 3 THEN 9 ELSE coalesce(slot, 1) % 4 END AS n, obs
  FROM {block_event} LATERAL VIEW explode(array(0, 1)) k AS obs
) LATERAL VIEW explode(CASE WHEN n > 0 THEN sequence(CAST(0 AS BIGINT), CAST(n - 1 AS BIGINT))
                       END) u AS i
"""

SIDECAR_CLIENT = """
SELECT slot, slot_start_date_time, slot_start_date_time AS event_date_time,
       concat('0xb', coalesce(slot, 0)) AS block_root, kzg_commitment,
       meta_consensus_implementation,
       blob_index, concat('0x01', kzg_commitment) AS versioned_hash,
       CAST(131072 AS BIGINT) AS blob_size, (slot * 37) % 131072 AS blob_empty_size
FROM (
  SELECT DISTINCT slot, slot_start_date_time, kzg_commitment, meta_consensus_implementation,
         blob_index
  FROM {sidecar_event} WHERE slot % 10 <> 0 OR slot IS NULL
)
"""


class Fixtures:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")

    @cached_property
    def base(self) -> DataFrame:
        return self.spark.sql(BASE, events=self.events)

    @cached_property
    def mempool(self) -> DataFrame:
        return self.spark.sql(MEMPOOL, base=self.base)

    @cached_property
    def blobset(self) -> DataFrame:
        return self.spark.sql(BLOBSET, base=self.base)

    @cached_property
    def sidecar(self) -> DataFrame:
        return self.spark.sql(SIDECAR, blobset=self.blobset)

    @cached_property
    def txs(self) -> DataFrame:
        return self.spark.sql(TXS, base=self.base, blobset=self.blobset)

    @cached_property
    def block_event(self) -> DataFrame:
        return self.spark.sql(BLOCK_EVENT, events=self.events)

    @cached_property
    def canonical_block(self) -> DataFrame:
        return self.spark.sql(CANONICAL_BLOCK, events=self.events)

    @cached_property
    def sidecar_event(self) -> DataFrame:
        return self.spark.sql(SIDECAR_EVENT, block_event=self.block_event)

    @cached_property
    def sidecar_client(self) -> DataFrame:
        return self.spark.sql(SIDECAR_CLIENT, sidecar_event=self.sidecar_event)

    @cached_property
    def sequencers(self) -> DataFrame:
        return sequencer_dim(self.spark, SEQUENCER_MAPPING)
