"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE, _TIME = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


MEMPOOL_TRANSACTION = _struct(
    **{
        "event_date_time": _TIME,
        "type": T.IntegerType(),
        "blob_sidecars_size": _LONG,
        "blob_sidecars_empty_size": _LONG,
        "hash": _STRING,
        "to": _STRING,
        "from": _STRING,
        "blob_hashes": T.ArrayType(_STRING),
        "nonce": _LONG,
        "meta_network_name": _STRING,
        # wei amounts are DOUBLE: their products overflow BIGINT
        "blob_gas": _DOUBLE,
        "blob_gas_fee_cap": _DOUBLE,
        "gas_price": _DOUBLE,
        "gas_tip_cap": _DOUBLE,
        "gas_fee_cap": _DOUBLE,
    }
)

CANONICAL_SIDECAR = _struct(
    slot=_LONG,
    slot_start_date_time=_TIME,
    event_date_time=_TIME,
    block_root=_STRING,
    kzg_commitment=_STRING,
    meta_network_name=_STRING,
    meta_consensus_implementation=_STRING,
    blob_index=_LONG,
    versioned_hash=_STRING,
    blob_size=_LONG,
    blob_empty_size=_LONG,
)

TRANSACTIONS = _struct(
    hash=_STRING,
    block_number=_LONG,
    extra_data=_STRING,
    base_fee_per_gas=_DOUBLE,
    gas_used=_DOUBLE,
    effective_gas_price=_DOUBLE,
    max_priority_fee_per_gas=_DOUBLE,
)

SEQUENCERS = _struct(sequencer_addresses=_STRING, sequencer_names=_STRING)

BLOCK_EVENT = _struct(
    event_date_time=_TIME,
    slot=_LONG,
    slot_start_date_time=_TIME,
    propagation_slot_start_diff=_LONG,
    block=_STRING,
    epoch=_LONG,
    meta_network_name=_STRING,
    meta_consensus_implementation=_STRING,
)

BLOB_SIDECAR_EVENT = _struct(
    kzg_commitment=_STRING,
    slot=_LONG,
    meta_consensus_implementation=_STRING,
    slot_start_date_time=_TIME,
    event_date_time=_TIME,
    blob_index=_LONG,
    meta_network_name=_STRING,
)

CANONICAL_BLOCK = _struct(
    slot=_LONG,
    slot_start_date_time=_TIME,
    block_root=_STRING,
    block_total_bytes_compressed=_LONG,
    execution_payload_transactions_total_bytes_compressed=_LONG,
    meta_consensus_implementation=_STRING,
    meta_network_name=_STRING,
    event_date_time=_TIME,
    version=_LONG,
)
