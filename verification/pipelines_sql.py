"""The pipelines as DuckDB SQL, written after the meaning of each step and not after the Spark plan:
one global window instead of blocks, LEFT joins with late NULL drops, plain medians."""

from verification.fixtures import FOUND_BLOB_COUNTS

MEANS = [
    "blob_hashes_length",
    "blob_sidecars_size",
    "fill_percentage",
    "blob_gas",
    "blob_gas_fee_cap",
    "gas_price",
    "gas_tip_cap",
    "gas_fee_cap",
]
_AVG = ", ".join(f"avg({c}) AS {c}" for c in MEANS)
_LATEST = '{\'t\': event_date_time, \'h\': hash, \'f\': "from", \'o\': "to"}'

SCAN_MEMPOOL = """
SELECT event_date_time, CAST(type AS BIGINT) AS type, blob_sidecars_size, blob_sidecars_empty_size,
       hash, "to", "from", blob_hashes, nonce, meta_network_name,
       CAST(len(blob_hashes) AS BIGINT) AS blob_hashes_length,
       round(100 - (blob_sidecars_empty_size / nullif(blob_sidecars_size, 0)) * 100, 2)
         AS fill_percentage,
       blob_gas, blob_gas_fee_cap, gas_price, gas_tip_cap, gas_fee_cap
FROM fx_mempool
WHERE event_date_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY AND type = 3"""

SCAN_SIDECAR = """
SELECT slot, slot_start_date_time, block_root, kzg_commitment, {scope}, blob_index,
       versioned_hash, blob_size, blob_empty_size
FROM {table}
WHERE event_date_time > TIMESTAMP '{as_of}' - INTERVAL {days} DAY"""

SCAN_BLOCK_EVENTS = """
SELECT event_date_time, slot, slot_start_date_time, propagation_slot_start_diff, block, epoch,
       meta_network_name, meta_consensus_implementation
FROM fx_block_event
WHERE event_date_time > TIMESTAMP '{as_of}' - INTERVAL {days} DAY
  AND meta_network_name = 'mainnet'"""

SPREAD = """
SELECT kzg_commitment, slot, meta_consensus_implementation,
       min(slot_start_date_time) AS min_slot_start_date_time,
       min(event_date_time) AS first_event_time, max(event_date_time) AS last_event_time,
       CAST(epoch_ms(max(event_date_time)) - epoch_ms(min(event_date_time)) AS BIGINT)
         AS time_diff_milliseconds,
       max(blob_index) AS max_blob_index
FROM fx_sidecar_event
WHERE event_date_time > TIMESTAMP '{as_of}' - INTERVAL {days} DAY
  AND meta_network_name = 'mainnet'
GROUP BY ALL"""

COMPLETE = " AND ".join(
    f'"{c}" IS NOT NULL'
    for c in [
        "slot",
        "slot_time",
        "hash",
        "fill_percentage",
        "submission_count",
        "slot_inclusion_rate",
        "sequencer_names",
        "meta_network_name",
        "blob_hashes_length",
        "block_number",
        "extra_data",
        "builder_label",
        "base_tx_fee_eth",
        "priority_tx_fee_eth",
        "base_fee_per_gas",
        "priority_fee_gas",
        "total_tx_fee_eth",
        "priority_fee_bid_percent_premium",
    ]
)

PIPELINES = {
    "mempool": SCAN_MEMPOOL.format(days=31),
    "sidecar": SCAN_SIDECAR.format(
        scope="meta_network_name", table="fx_sidecar", as_of="2024-01-31 00:00:00", days=31
    ),
    "by_nonce": f"""
SELECT versioned_hash, nonce, event_date_time_min, event_date_time_max, {", ".join(MEANS)},
       latest.h AS hash, latest.f AS "from", latest.o AS "to"
FROM (SELECT blob_hashes AS versioned_hash, nonce, min(event_date_time) AS event_date_time_min,
             max(event_date_time) AS event_date_time_max, {_AVG}, max({_LATEST}) AS latest
      FROM mempool GROUP BY blob_hashes, nonce)""",
    "by_tx": f"""
SELECT blob_hashes AS versioned_hash, hash, "from", "to", nonce,
       min(event_date_time) AS event_date_time_min, max(event_date_time) AS event_date_time_max,
       {_AVG}
FROM mempool GROUP BY blob_hashes, hash, "from", "to", nonce""",
    "counted": """
SELECT *, count(*) OVER (PARTITION BY versioned_hash) AS submission_count FROM by_nonce""",
    "exploded": """
SELECT unnest(CASE WHEN len(versioned_hash) = 0 THEN [NULL] ELSE versioned_hash END)
         AS versioned_hash, * EXCLUDE (versioned_hash)
FROM counted""",
    "matched": """
SELECT DISTINCT e.*, s.* EXCLUDE (versioned_hash, blob_index)
FROM exploded e LEFT JOIN sidecar s ON e.versioned_hash = s.versioned_hash""",
    "timed": """
SELECT *, ceil(abs(beacon_inclusion_time / 12)) AS num_slot_inclusion
FROM (SELECT *, (epoch_us(slot_start_date_time) - epoch_us(event_date_time_min)) / 1e6
               AS beacon_inclusion_time FROM matched)""",
    "rolled": """
SELECT * RENAME (slot_start_date_time AS slot_time, num_slot_inclusion AS slot_inclusion_rate),
       CASE WHEN count(num_slot_inclusion) OVER w = 50 THEN avg(num_slot_inclusion) OVER w END
         AS slot_inclusion_rate_50_blob_avg,
       CAST(2 AS BIGINT) AS "2_slot_target_inclusion_rate"
FROM timed
WINDOW w AS (
  ORDER BY slot_start_date_time NULLS FIRST, versioned_hash NULLS FIRST, nonce, meta_network_name,
           block_root, kzg_commitment, slot, hash, "from", "to", event_date_time_min
  ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "incl": """
SELECT * FROM rolled
WHERE slot_time IS NOT NULL AND fill_percentage IS NOT NULL
  AND slot_inclusion_rate_50_blob_avg IS NOT NULL AND versioned_hash IS NOT NULL
  AND meta_network_name = 'mainnet' AND slot_inclusion_rate < 200""",
    "tx_labels": """
SELECT *, CASE WHEN extra_data IS NULL THEN NULL
               WHEN contains(txt, 'geth') THEN 'vanilla_builder_geth'
               WHEN contains(txt, 'reth') THEN 'vanilla_builder_reth'
               WHEN contains(txt, 'rsync') THEN 'rsync_builder'
               ELSE txt END AS builder_label
FROM (SELECT * EXCLUDE (digits),
             array_to_string(list_transform(range(0, len(digits), 2),
               lambda i: chr(CAST(concat('0x', digits[i + 1:i + 2]) AS INTEGER))), '') AS txt
      FROM (SELECT *, substr(extra_data, 3) AS digits FROM fx_txs))""",
    "fees": """
SELECT i.* , t.block_number, t.extra_data, t.builder_label,
       t.base_fee_per_gas * t.gas_used / 1e18 AS base_tx_fee_eth,
       (t.effective_gas_price - t.base_fee_per_gas) * t.gas_used / 1e18 AS priority_tx_fee_eth,
       t.base_fee_per_gas * t.gas_used / 1e18
         + (t.effective_gas_price - t.base_fee_per_gas) * t.gas_used / 1e18 AS total_tx_fee_eth,
       t.base_fee_per_gas / 1e9 AS base_fee_per_gas,
       (t.effective_gas_price - t.base_fee_per_gas) / 1e9 AS priority_fee_gas,
       t.effective_gas_price / 1e9 AS effective_gas_price_gwei,
       round(t.max_priority_fee_per_gas / nullif(t.effective_gas_price, 0), 3)
         AS priority_fee_bid_percent_premium
FROM incl i LEFT JOIN tx_labels t ON i.hash = t.hash""",
    "gas": """
SELECT DISTINCT block_number, extra_data, builder_label, base_tx_fee_eth, priority_tx_fee_eth,
       total_tx_fee_eth, base_fee_per_gas, priority_fee_gas, meta_network_name,
       priority_fee_bid_percent_premium, slot_inclusion_rate, submission_count, hash, "from"
FROM fees
WHERE block_number IS NOT NULL AND extra_data IS NOT NULL
  AND priority_fee_bid_percent_premium IS NOT NULL AND meta_network_name = 'mainnet'""",
    "with_rollup": """
SELECT i.*, d.sequencer_names
FROM incl i LEFT JOIN fx_sequencers d ON i."from" = d.sequencer_addresses""",
    "joined": """
SELECT i.slot, i.slot_time, i.hash, i.fill_percentage, i.submission_count, i.slot_inclusion_rate,
       i.sequencer_names, i.meta_network_name, i.blob_hashes_length,
       g.block_number, g.extra_data, g.builder_label, g.base_tx_fee_eth, g.priority_tx_fee_eth,
       g.base_fee_per_gas, g.priority_fee_gas, g.total_tx_fee_eth,
       g.priority_fee_bid_percent_premium
FROM with_rollup i LEFT JOIN gas g ON i.hash = g.hash""",
    "filtered": """
SELECT DISTINCT * FROM joined
WHERE sequencer_names IN (SELECT sequencer_names FROM fx_sequencers)
  AND meta_network_name = 'mainnet'""",
    "gas_groups": """
SELECT * FROM (
  SELECT slot_inclusion_rate, sequencer_names,
         median(priority_fee_bid_percent_premium) AS priority_fee_bid_percent_premium,
         avg(base_fee_per_gas) AS base_fee_per_gas
  FROM filtered GROUP BY slot_inclusion_rate, sequencer_names)
WHERE slot_inclusion_rate IS NOT NULL AND sequencer_names IS NOT NULL
  AND priority_fee_bid_percent_premium IS NOT NULL AND base_fee_per_gas IS NOT NULL""",
    "complete": f"SELECT DISTINCT * FROM joined WHERE {COMPLETE}",
    "blob_blocks": """
SELECT block_number, sequencer_names, min(slot_time) AS slot_time, min(extra_data) AS extra_data,
       sum(base_tx_fee_eth) AS base_fees_per_block_eth,
       sum(priority_tx_fee_eth) AS priority_fees_per_block_eth,
       sum(total_tx_fee_eth) AS total_tx_fees_per_block_eth,
       avg(slot_inclusion_rate) AS avg_slot_inclusion_rate_per_block,
       avg(priority_fee_gas) AS avg_priority_fee_gas_per_block_gwei,
       avg(base_fee_per_gas) AS base_fee_per_gas,
       sum(blob_hashes_length) AS blobs_per_block
FROM complete GROUP BY block_number, sequencer_names""",
    "block_aggs": """
SELECT slot_time, min(block_number) AS block_number, min(extra_data) AS extra_data,
       sum(base_fees_per_block_eth) AS base_fees_per_block_eth,
       sum(priority_fees_per_block_eth) AS priority_fees_per_block_eth,
       sum(total_tx_fees_per_block_eth) AS total_tx_fees_per_block_eth,
       avg(avg_slot_inclusion_rate_per_block) AS avg_slot_inclusion_rate_per_block,
       avg(avg_priority_fee_gas_per_block_gwei) AS avg_priority_fee_gas_per_block_gwei,
       avg(base_fee_per_gas) AS base_fee_per_gas, sum(blobs_per_block) AS blobs_per_block
FROM blob_blocks GROUP BY slot_time""",
    "macro": """
SELECT sequencer_names AS rollup, avg(fill_percentage) AS avg_fill_percentage,
       avg(submission_count) AS avg_submission_count,
       round(avg(slot_inclusion_rate), 3) AS avg_slot_inclusion_rate,
       avg(blob_hashes_length) AS avg_blobs_in_tx, count(*) AS tx_count,
       sum(blob_hashes_length) AS blob_count,
       round(sum(base_tx_fee_eth), 3) AS total_base_fees_eth,
       round(sum(priority_tx_fee_eth), 3) AS total_priority_fees_eth,
       round(sum(total_tx_fee_eth), 3) AS total_eth_fees,
       round(avg(priority_fee_gas), 3) AS avg_priority_fee_bid
FROM complete GROUP BY sequencer_names""",
    "builders": """
SELECT builder_label, round(avg(slot_inclusion_rate), 3) AS slot_inclusion_rate,
       round(sum(priority_tx_fee_eth), 3) AS "priority fees collected (eth)",
       round(avg(blob_hashes_length), 3) AS blob_hashes_length,
       count(*) AS blob_tx_count, count(DISTINCT block_number) AS block_count
FROM joined WHERE sequencer_names <> 'base'
GROUP BY builder_label
HAVING count(*) > 100 AND builder_label IS NOT NULL""",
    "rollup_tx": """
SELECT *, count(*) OVER (PARTITION BY versioned_hash) AS submission_count
FROM (
  SELECT t.* FROM (
    SELECT blob_hashes AS versioned_hash, hash, "from", "to", nonce,
           min(event_date_time) AS event_date_time_min, """
    + _AVG
    + """
    FROM mempool WHERE "from" = '0xSEQ1' AND meta_network_name = 'mainnet'
    GROUP BY blob_hashes, hash, "from", "to", nonce) t)""",
    "rollup_incl": """
SELECT *, ceil(abs(beacon_inclusion_time / 12)) AS num_block_inclusion
FROM (
  SELECT DISTINCT e.*, s.* EXCLUDE (versioned_hash, blob_index),
         (epoch_us(slot_start_date_time) - epoch_us(event_date_time_min)) / 1e6
           AS beacon_inclusion_time
  FROM (SELECT unnest(CASE WHEN len(versioned_hash) = 0 THEN [NULL] ELSE versioned_hash END)
                 AS versioned_hash, * EXCLUDE (versioned_hash)
        FROM rollup_tx) e
  LEFT JOIN sidecar s ON e.versioned_hash = s.versioned_hash)""",
    "bids": """
SELECT nonce, versioned_hash, max(submission_count) AS submission_count,
       max(gas_tip_cap) - min(gas_tip_cap) AS gas_tip_diff,
       avg(num_block_inclusion) AS num_block_inclusion,
       min(gas_tip_cap) AS min_gas_tip_cap, max(gas_tip_cap) AS max_gas_tip_cap,
       min(gas_fee_cap) AS min_gas_fee_cap, max(gas_fee_cap) AS max_gas_fee_cap,
       min(blob_gas_fee_cap) AS min_blob_gas_fee_cap, max(blob_gas_fee_cap) AS max_blob_gas_fee_cap
FROM rollup_incl GROUP BY nonce, versioned_hash""",
    "listed": """
SELECT * REPLACE (array_to_string(blob_hashes, ',') AS blob_hashes) FROM mempool""",
    "counts": """
SELECT blob_hashes, count(*) AS count, min(event_date_time) AS event_date_time,
       arg_min(nonce, {'t': event_date_time, 'n': nonce}) AS nonce
FROM listed GROUP BY blob_hashes""",
    "block_events": SCAN_BLOCK_EVENTS.format(as_of="2024-01-31 00:00:00", days=31),
    "canonical": """
SELECT slot, slot_start_date_time, block_root AS block, block_total_bytes_compressed,
       execution_payload_transactions_total_bytes_compressed, meta_consensus_implementation
FROM (SELECT * FROM fx_canonical_block WHERE meta_network_name = 'mainnet'
      QUALIFY row_number() OVER (PARTITION BY slot
                                 ORDER BY version DESC, slot_start_date_time DESC) = 1)
WHERE event_date_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 31 DAY""",
    "spread": SPREAD.format(as_of="2024-01-31 00:00:00", days=31),
    "sidecar_client": SCAN_SIDECAR.format(
        scope="meta_consensus_implementation",
        table="fx_sidecar_client",
        as_of="2024-01-31 00:00:00",
        days=31,
    ),
    "bsj": """
SELECT DISTINCT e.event_date_time, coalesce(e.slot, -1) AS slot, e.slot_start_date_time, e.propagation_slot_start_diff,
       e.block, e.epoch, e.meta_network_name, e.meta_consensus_implementation,
       c.slot_start_date_time AS slot_start_date_time_canonical_block,
       c.block AS block_canonical_block,
       coalesce(c.block_total_bytes_compressed, -1) AS block_total_bytes_compressed,
       coalesce(c.execution_payload_transactions_total_bytes_compressed, -1)
         AS execution_payload_transactions_total_bytes_compressed,
       c.meta_consensus_implementation AS meta_consensus_implementation_canonical_block,
       s.kzg_commitment, s.first_event_time, s.last_event_time,
       coalesce(s.time_diff_milliseconds, -1) AS time_diff_milliseconds,
       coalesce(s.max_blob_index, -1) + 1 AS max_blob_index,
       coalesce(x.slot, -1) AS slot_canonical_blob,
       x.slot_start_date_time AS slot_start_date_time_canonical_blob, x.block_root,
       coalesce(x.blob_index, -1) AS blob_index, x.versioned_hash,
       coalesce(x.blob_size, -1) AS blob_size, coalesce(x.blob_empty_size, -1) AS blob_empty_size
FROM block_events e
LEFT JOIN canonical c ON e.slot = c.slot
LEFT JOIN spread s ON e.slot = s.slot
  AND e.meta_consensus_implementation = s.meta_consensus_implementation
LEFT JOIN sidecar_client x ON s.kzg_commitment = x.kzg_commitment
  AND e.meta_consensus_implementation = x.meta_consensus_implementation
WHERE e.propagation_slot_start_diff < 12500""",
    "client_table": """
SELECT max_blob_index, meta_consensus_implementation, count(*) AS count,
       avg(propagation_slot_start_diff) AS mean_propagation_slot_start_diff,
       avg(block_total_bytes_compressed) / 1000 AS mean_block_size_compressed
FROM bsj GROUP BY max_blob_index, meta_consensus_implementation""",
    "slot_prop": """
SELECT slot, max_blob_index, min(slot_start_date_time) AS slot_start_date_time,
       avg(propagation_slot_start_diff) AS propagation_slot_start_diff
FROM bsj GROUP BY slot, max_blob_index""",
    "slot_pivot": "SELECT slot_start_date_time, "
    + ", ".join(
        f"max(CASE WHEN max_blob_index = {n} THEN propagation_slot_start_diff END) AS blobs_{n}"
        for n in FOUND_BLOB_COUNTS
    )
    + " FROM slot_prop GROUP BY slot_start_date_time",
    "per_client": """
SELECT slot, meta_consensus_implementation, slot_start_date_time,
       propagation_slot_start_diff AS delay, mean_delay, block, epoch,
       slot_start_date_time_canonical_block, block_canonical_block, blob_count
FROM (
  SELECT *, max(max_blob_index) OVER g AS blob_count,
         avg(propagation_slot_start_diff) OVER g AS mean_delay,
         row_number() OVER (
           PARTITION BY slot, meta_consensus_implementation
           ORDER BY propagation_slot_start_diff DESC, slot_start_date_time DESC, block DESC,
                    epoch DESC, slot_start_date_time_canonical_block DESC NULLS LAST,
                    block_canonical_block DESC NULLS LAST) AS rn
  FROM bsj
  WHERE slot < 10000000
  WINDOW g AS (PARTITION BY slot, meta_consensus_implementation))
WHERE rn = 1""",
    "reorged": """
SELECT * EXCLUDE (mean_delay) RENAME (delay AS propagation_slot_start_diff) FROM per_client""",
    "labeled": """
SELECT slot, meta_consensus_implementation, slot_start_date_time,
       mean_delay / 1000 AS propagation_slot_start_diff, block, epoch,
       slot_start_date_time_canonical_block, block_canonical_block, blob_count,
       CASE WHEN blob_count = 0 THEN 'no blobs' ELSE 'blobs' END AS has_blobs,
       CASE WHEN slot_start_date_time_canonical_block IS NULL THEN 'reorged' ELSE 'finalized' END
         AS reorged
FROM per_client""",
}
