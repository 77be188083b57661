"""The tables of `fixtures.py` as DuckDB common table expressions over `events`."""

FIXTURES = {
    "fx_base": """
SELECT event_id, ts, value, g, b, CASE WHEN b % 29 = 0 THEN 0 ELSE 1 + b % 6 END AS n
FROM (
  SELECT event_id, ts, value, g,
         CASE WHEN CAST((g - g % 2) / 2 AS BIGINT) % 4 = 0 THEN g - g % 2 ELSE g END AS b
  FROM (SELECT event_id, ts, value, CAST((event_id - event_id % 3) / 3 AS BIGINT) AS g
        FROM events) e1) e2""",
    "fx_mempool": """
SELECT event_id, ts AS event_date_time, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 3 END AS type,
       n * 131072 AS blob_sidecars_size,
       n * ((b * 3701) % 131072) AS blob_sidecars_empty_size,
       concat('0xtx', CAST(g AS VARCHAR),
              CASE WHEN g % 5 = 0 AND event_id % 3 = 2 THEN 'r1' ELSE 'r0' END) AS hash,
       concat('0xto', CAST(b % 12 AS VARCHAR)) AS "to",
       concat('0xSEQ', CAST(b % 12 AS VARCHAR)) AS "from",
       [concat('0x01-', CAST(b AS VARCHAR), '-', CAST(i AS VARCHAR))
        for i in range(CAST(n AS BIGINT))] AS blob_hashes,
       g AS nonce, CASE WHEN b % 9 = 0 THEN 'holesky' ELSE 'mainnet' END AS meta_network_name,
       CAST(n * 131072 AS DOUBLE) AS blob_gas,
       CAST((1 + b % 9) * 1000000000 AS DOUBLE) AS blob_gas_fee_cap,
       20000000000.0e0 + CAST(1 + event_id % 50 AS DOUBLE) * 1000000000 AS gas_price,
       CAST(1 + event_id % 4 AS DOUBLE) * 1000000000 AS gas_tip_cap,
       20000000000.0e0 + CAST(1 + event_id % 50 AS DOUBLE) * 1000000000 AS gas_fee_cap
FROM fx_base""",
    "fx_blobset": """
SELECT b, n,
       CAST(floor(sec / 12) AS BIGINT)
         + CASE WHEN b % 50 = 49 THEN 250 WHEN b % 19 = 0 THEN -60 ELSE 1 + b % 40 END AS slot
FROM (SELECT b, max(n) AS n, min(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) AS sec
      FROM fx_base GROUP BY b) x
WHERE b % 13 <> 0""",
    "fx_sidecar": """
SELECT slot, make_timestamp(CAST(slot * 12 AS BIGINT) * 1000000) AS slot_start_date_time,
       make_timestamp(CAST(slot * 12 + 4 AS BIGINT) * 1000000) AS event_date_time,
       concat('0xblk', CAST(slot AS VARCHAR)) AS block_root,
       concat('0xkzg', CAST(b AS VARCHAR), '-', CAST(i AS VARCHAR)) AS kzg_commitment,
       net AS meta_network_name, i AS blob_index,
       concat('0x01-', CAST(b AS VARCHAR), '-', CAST(i AS VARCHAR)) AS versioned_hash,
       CAST(131072 AS BIGINT) AS blob_size, (b * 3701) % 131072 AS blob_empty_size
FROM (SELECT b, n, slot, 'mainnet' AS net FROM fx_blobset WHERE n > 0
      UNION ALL
      SELECT b, n, slot, 'holesky' FROM fx_blobset WHERE b % 17 = 0 AND n > 0) y,
     unnest(range(n)) u(i)""",
    "fx_txs": """
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
FROM (SELECT m.hash, m.nonce, s.slot FROM fx_mempool m
      JOIN fx_base f ON m.event_id = f.event_id JOIN fx_blobset s ON f.b = s.b) z
WHERE nonce % 23 <> 0
GROUP BY hash""",
    "fx_block_event": """
SELECT CASE WHEN s % 41 = 7 THEN NULL ELSE s END AS slot,
       make_timestamp(CAST(1704067200 + s * 12 AS BIGINT) * 1000000) AS slot_start_date_time,
       make_timestamp(CAST((1704067200 + s * 12) * 1000 + diff AS BIGINT) * 1000)
         AS event_date_time,
       diff AS propagation_slot_start_diff, concat('0xb', CAST(s AS VARCHAR)) AS block,
       CAST(floor(s / 32) AS BIGINT) AS epoch, 'mainnet' AS meta_network_name,
       client AS meta_consensus_implementation
FROM (SELECT event_id AS s, CAST(floor(value * 100) AS BIGINT) + c AS diff,
             CASE WHEN event_id % 37 = 0 THEN 'grandine' ELSE
             CASE (event_id + c) % 5 WHEN 0 THEN 'lighthouse' WHEN 1 THEN 'prysm' WHEN 2 THEN 'teku'
                  WHEN 3 THEN 'lodestar' ELSE 'nimbus' END END AS client
      FROM events CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) k) q""",
    "fx_canonical_block": """
SELECT CASE WHEN event_id % 43 = 5 THEN NULL ELSE event_id END AS slot,
       make_timestamp(CAST(1704067200 + event_id * 12 AS BIGINT) * 1000000)
         AS slot_start_date_time,
       concat('0xb', CAST(event_id AS VARCHAR)) AS block_root,
       CAST(50000 + event_id % 1000 + 7 * v AS BIGINT) AS block_total_bytes_compressed,
       CAST(30000 + event_id % 700 AS BIGINT)
         AS execution_payload_transactions_total_bytes_compressed,
       'lighthouse' AS meta_consensus_implementation, 'mainnet' AS meta_network_name,
       make_timestamp(CAST(1704067200 + event_id * 12 + 12
                           - CASE WHEN v = 2 THEN 3456000 ELSE 0 END AS BIGINT) * 1000000)
         AS event_date_time,
       CAST(v AS BIGINT) AS version
FROM events CROSS JOIN range(3) k(v)
WHERE event_id % 10 <> 0
  AND (v = 0 OR v = 1 AND event_id % 6 = 0 OR v = 2 AND event_id % 22 = 4)""",
    "fx_sidecar_event": """
SELECT concat('0xkzg', CAST(s AS VARCHAR), '-', CAST(i AS VARCHAR)) AS kzg_commitment, slot,
       client AS meta_consensus_implementation, slot_start_date_time,
       make_timestamp(CAST((1704067200 + s * 12) * 1000 + 1500 + 200 * i + 37 * obs
                           AS BIGINT) * 1000) AS event_date_time,
       i AS blob_index, 'mainnet' AS meta_network_name
FROM (SELECT slot, slot_start_date_time, coalesce(slot, 0) AS s,
             meta_consensus_implementation AS client,
             CASE WHEN slot % 30 = 3 THEN 9 ELSE coalesce(slot, 1) % 4 END AS n, obs
      FROM fx_block_event CROSS JOIN (SELECT 0 AS obs UNION ALL SELECT 1) k) q,
     unnest(range(n)) u(i)""",
    "fx_sidecar_client": """
SELECT slot, slot_start_date_time, slot_start_date_time AS event_date_time,
       concat('0xb', CAST(coalesce(slot, 0) AS VARCHAR)) AS block_root, kzg_commitment,
       meta_consensus_implementation, blob_index,
       concat('0x01', kzg_commitment) AS versioned_hash,
       CAST(131072 AS BIGINT) AS blob_size, (slot * 37) % 131072 AS blob_empty_size
FROM (SELECT DISTINCT slot, slot_start_date_time, kzg_commitment, meta_consensus_implementation,
             blob_index
      FROM fx_sidecar_event WHERE slot % 10 <> 0 OR slot IS NULL) q""",
    "fx_sequencers": """
SELECT * FROM (VALUES
  ('0xSEQ0', 'arbitrum'), ('0xSEQ1', 'base'), ('0xSEQ2', 'optimism'), ('0xSEQ3', 'taiko'),
  ('0xSEQ4', 'blast'), ('0xSEQ5', 'linea'), ('0xSEQ6', 'scroll'), ('0xSEQ7', 'zksync'),
  ('0xSEQ8', 'paradex'), ('0xSEQ9', 'metal')) t(sequencer_addresses, sequencer_names)""",
}
