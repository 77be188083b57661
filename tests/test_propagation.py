from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blobtide import schemas
from blobtide.operators import distributions
from blobtide.plans import propagation, resubmission

T0 = datetime(2024, 3, 28)


def events(spark, *rows):
    """Rows are (slot, client, delay)."""
    data = [
        (T0, s, T0 + timedelta(seconds=12 * s), d, f"0xb{s}", s // 32, "mainnet", c)
        for s, c, d in rows
    ]
    return spark.createDataFrame(data, schemas.BLOCK_EVENT)


def joined(spark):
    blocks = spark.createDataFrame(
        [(1, T0, "0xb1", 1000, 500, "teku")],
        "slot long, slot_start_date_time timestamp_ntz, block string,"
        " block_total_bytes_compressed long,"
        " execution_payload_transactions_total_bytes_compressed long,"
        " meta_consensus_implementation string",
    )
    spread = propagation.blob_sidecar_spread(
        spark.createDataFrame(
            [
                ("k0", 1, "teku", T0, T0 + timedelta(milliseconds=ms), 0, "mainnet")
                for ms in (100, 350)
            ]
            + [("k1", 1, "teku", T0, T0, 1, "mainnet"), ("k9", 1, "teku", T0, T0, 1, "holesky")],
            schemas.BLOB_SIDECAR_EVENT,
        ),
        T0 + timedelta(hours=1),
    )
    sidecars = spark.createDataFrame(
        [
            (1, T0, "0xb1", "k0", "teku", 0, "v0", 131072, 7),
            (1, T0, "0xb1", "k1", "prysm", 1, "v1", 131072, 7),
        ],
        "slot long, slot_start_date_time timestamp_ntz, block_root string, kzg_commitment string,"
        " meta_consensus_implementation string, blob_index long, versioned_hash string,"
        " blob_size long, blob_empty_size long",
    )
    return propagation.block_sidecar_joined(
        events(
            spark,
            (1, "teku", 900), (1, "teku", 900), (1, "teku", 1200), (1, "teku", 12500),
            (2, "prysm", 400), (2, "prysm", 800),
        ),
        blocks,
        spread,
        sidecars,
    )


def test_block_sidecar_joined(spark, many_partitions):
    rows = joined(spark).collect()
    got = sorted(
        (r.slot, r.propagation_slot_start_diff, r.max_blob_index, r.versioned_hash or "",
         r.time_diff_milliseconds, r.block_total_bytes_compressed, r.blob_size)
        for r in rows
    )
    assert got == [
        # per commitment its own index; k1 was recorded under another client
        (1, 900, 1, "v0", 250, 1000, 131072),
        (1, 900, 2, "", 0, 1000, -1),
        (1, 1200, 1, "v0", 250, 1000, 131072),
        (1, 1200, 2, "", 0, 1000, -1),
        # no blobs, no canonical block
        (2, 400, 0, "", -1, -1, -1),
        (2, 800, 0, "", -1, -1, -1),
    ]
    assert {r.block_canonical_block for r in rows if r.slot == 2} == {None}


def test_reorged_blocks_take_the_most_delayed_sighting(spark, many_partitions):
    got = {r.slot: r for r in propagation.reorged_blocks(joined(spark)).collect()}
    assert (got[1].propagation_slot_start_diff, got[1].blob_count) == (1200, 2)
    assert (got[2].propagation_slot_start_diff, got[2].blob_count) == (800, 0)
    assert set(propagation.reorged_blocks(joined(spark), max_slot=2).select("slot").toPandas().slot) == {1}
    labeled = {r.slot: r for r in propagation.reorged_blocks_labeled(joined(spark)).collect()}
    assert (labeled[1].has_blobs, labeled[1].reorged) == ("blobs", "finalized")
    assert (labeled[2].has_blobs, labeled[2].reorged) == ("no blobs", "reorged")
    assert labeled[2].propagation_slot_start_diff == 0.6
    missed = propagation.missed_by_blob_count(
        propagation.reorged_blocks(joined(spark)), T0 - timedelta(days=1)
    )
    assert [tuple(r) for r in missed.collect()] == [(0, 1, 0), (2, 0, 1)]


def test_rolling_propagation_counts_slots_without_a_value(spark, many_partitions):
    df = spark.createDataFrame(
        [(s, b, T0 + timedelta(seconds=12 * s), 1000.0 * (s + 1)) for s, b in enumerate([0, 2, 1, 0])],
        "slot long, max_blob_index long, slot_start_date_time timestamp_ntz,"
        " propagation_slot_start_diff double",
    )
    rows = propagation.rolling_propagation(df, n=2).orderBy("slot_start_date_time").collect()
    assert [r.rolling_blobs_0 for r in rows] == [1.0, 1.0, None, 4.0]
    assert [r.rolling_blobs_1 for r in rows] == [None, None, 3.0, 3.0]


def mempool(spark, rows):
    """Rows are (list, nonce, second, hash)."""
    return spark.createDataFrame(
        [(T0 + timedelta(seconds=s), b, n, h, 1e9, 2e9, 3e9, 4e9) for b, n, s, h in rows],
        "event_date_time timestamp_ntz, blob_hashes array<string>, nonce long, hash string,"
        " blob_gas_fee_cap double, gas_price double, gas_tip_cap double, gas_fee_cap double",
    )


def test_resubmission_lookups(spark, many_partitions):
    df = mempool(
        spark,
        [(["a"], 5, 10, "x"), (["a"], 4, 0, "y"), (["a"], 4, 2, "y"), (["b", "c"], 7, 1, "z"),
         (["d"], 9, 3, "w"), (["e"], 8, 2, "v")],
    )
    counts = resubmission.resubmission_counts(df)
    rows = {r.blob_hashes: r for r in counts.collect()}
    assert (rows["a"]["count"], rows["a"].nonce, rows["a"].event_date_time) == (3, 4, T0)
    assert rows["b,c"]["count"] == 1
    worst = resubmission.worst_case_resubmission(df, counts).collect()
    assert [(r.hash, r["count"], r.nonce, r.gas_price) for r in worst] == [("y", 2, 4, 2.0), ("x", 1, 5, 2.0)]
    assert worst[0].mean_event_date_time == T0 + timedelta(seconds=1)
    # among the lists seen once, ordered by first sighting: b,c then e then d
    second = resubmission.worst_case_resubmission(df, counts, rank=2, count=1).collect()
    assert [r.hash for r in second] == ["v"]
    assert resubmission.worst_case_resubmission(df, counts, rank=9).count() == 0
    assert [r.nonce for r in resubmission.nonce_neighbourhood(counts, 4, 9).collect()] == [7, 8]
    assert [r.hash for r in resubmission.followup_by_nonce(df, counts, 4).collect()] == ["y", "y", "x"]


def test_pivots_have_a_column_for_every_value(spark):
    table = spark.createDataFrame(
        [(10, "grandine", 4000.0), (10, "prysm", 1000.0)],
        f"max_blob_index int, {propagation.CLIENT} string, mean_propagation_slot_start_diff double",
    )
    row = propagation.propagation_pivot(table).first()
    assert (row.grandine, row.prysm) == (4.0, 1.0)
    with pytest.raises(ValueError, match="grandine"):
        propagation.propagation_pivot(table, propagation.CLIENTS)
    slots = spark.createDataFrame(
        [("s", 9, 9000.0), ("t", 0, 1.0)],
        f"slot_start_date_time string, max_blob_index int, {propagation.DELAY} double",
    )
    assert propagation.slow_one_blob_slots(slots, blobs=9).first().blobs_9 == 9000.0
    assert propagation.slow_one_blob_slots(slots).columns[1:] == ["blobs_0", "blobs_1", "blobs_9"]
    with pytest.raises(ValueError, match="9"):
        propagation.propagation_by_blobs(slots, propagation.BLOB_COUNTS)


def test_null_groups_have_bins_boxes_and_densities(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    bins = distributions.histogram(df, "v", ["g"], bins=2).where("g IS NULL").orderBy("bin").collect()
    assert [b["count"] for b in bins] == [1, 1]
    assert distributions.box_stats(df, "v", ["g"]).where("g IS NULL").first()["median"] == 2.0
    assert distributions.density(df, "v", ["g"], grid=3).where("g IS NULL").count() == 3


def test_a_null_slot_matches_nothing(spark):
    sightings = events(spark, (1, "teku", 100)).unionByName(
        events(spark, (1, "teku", 200), (-1, "teku", 300)).withColumn(
            "slot", F.expr("CASE WHEN propagation_slot_start_diff = 200 THEN NULL ELSE slot END")
        )
    )
    blocks = spark.createDataFrame(
        [(None, T0, "0xnull", 1, 1, "teku"), (-1, T0, "0xminus", 2, 2, "teku")],
        "slot long, slot_start_date_time timestamp_ntz, block string, block_total_bytes_compressed long,"
        " execution_payload_transactions_total_bytes_compressed long, meta_consensus_implementation string",
    )
    spread = spark.createDataFrame(
        [("k", None, "teku", T0, T0, T0, 5, 0)],
        "kzg_commitment string, slot long, meta_consensus_implementation string, min_slot_start_date_time timestamp_ntz,"
        " first_event_time timestamp_ntz, last_event_time timestamp_ntz, time_diff_milliseconds long, max_blob_index long",
    )
    sidecar = spark.createDataFrame(
        [], "slot long, slot_start_date_time timestamp_ntz, block_root string, kzg_commitment string,"
        " meta_consensus_implementation string, blob_index long, versioned_hash string, blob_size long, blob_empty_size long",
    )
    got = {
        r.propagation_slot_start_diff: (r.slot, r.block_canonical_block, r.max_blob_index)
        for r in propagation.block_sidecar_joined(sightings, blocks, spread, sidecar).collect()
    }
    # NULL finds neither the block nor the blobs without a slot; a slot of -1 is a slot
    assert got == {100: (1, None, 0), 200: (-1, None, 0), 300: (-1, "0xminus", 0)}
