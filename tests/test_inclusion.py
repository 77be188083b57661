"""Hand-made cases of the path from mempool sightings to slots and fees."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blobtide import schemas
from blobtide.operators import ordered
from blobtide.plans import fees, inclusion
from blobtide.sources import scans

T0 = datetime(2024, 5, 1, 18, 54, 29)


def sighting(hashes, nonce=1, tx="0xa", seen=T0, sender="0xS", network="mainnet", size=131072, **kw):
    row = {
        "event_date_time": seen,
        "type": 3,
        "blob_sidecars_size": size,
        "blob_sidecars_empty_size": size // 2,
        "hash": tx,
        "to": "0xto",
        "from": sender,
        "blob_hashes": hashes,
        "nonce": nonce,
        "meta_network_name": network,
        "blob_gas": 1.0,
        "blob_gas_fee_cap": 1e9,
        "gas_price": 2e10,
        "gas_tip_cap": 1e9,
        "gas_fee_cap": 2e10,
    }
    return tuple({**row, **kw}[name] for name in schemas.MEMPOOL_TRANSACTION.fieldNames())


def mempool(spark, *rows):
    raw = spark.createDataFrame(list(rows), schemas.MEMPOOL_TRANSACTION)
    return scans.scan_mempool(raw, datetime(2024, 5, 2), 7)


def sidecars(spark, *rows):
    """Rows are (versioned_hash, slot start, network)."""
    data = [
        (int(start.timestamp()) // 12, start, start, "0xroot", f"0xkzg{h}", net, None, i, h, 131072, 10)
        for i, (h, start, net) in enumerate(rows)
    ]
    raw = spark.createDataFrame(data, schemas.CANONICAL_SIDECAR)
    return scans.scan_canonical_sidecar(raw, datetime(2024, 5, 2), 7)


def test_waiting_time_counts_from_the_first_submission(spark, many_partitions):
    first, second = T0, datetime(2024, 5, 1, 18, 56, 27)
    slot = datetime(2024, 5, 1, 18, 57, 11)
    df = inclusion.process_rollup(
        mempool(
            spark,
            sighting(["h1"], nonce=1, tx="0xa", seen=first),
            sighting(["h1"], nonce=1, tx="0xb", seen=second),
            sighting(["h9"], nonce=1, tx="0xc", sender="0xOther"),
        ),
        sidecars(spark, ("h1", slot, "mainnet")),
        "0xS",
    )
    got = {r.hash: (r.num_block_inclusion, r.submission_count) for r in df.collect()}
    assert got == {"0xa": (14.0, 2), "0xb": (4.0, 2)}

    by_nonce = inclusion.mempool_by_nonce(
        mempool(
            spark,
            sighting(["h1"], tx="0xa", seen=first),
            sighting(["h1"], tx="0xb", seen=second),
        )
    ).collect()
    assert len(by_nonce) == 1 and by_nonce[0].hash == "0xb"
    assert by_nonce[0].event_date_time_min == first
    assert by_nonce[0].event_date_time_max == second


def test_last_transaction_is_kept_whole_with_nulls_and_ties(spark, many_partitions):
    rows = inclusion.mempool_by_nonce(
        mempool(
            spark,
            sighting(["h"], nonce=1, tx="0xa", to="0x1"),
            sighting(["h"], nonce=1, tx="0xb", seen=T0 + timedelta(seconds=1), to=None),
            sighting(["h"], nonce=2, tx="0xc"),
            sighting(["h"], nonce=2, tx="0xd"),
        )
    ).collect()
    assert {r.nonce: (r.hash, r.to) for r in rows} == {1: ("0xb", None), 2: ("0xd", "0xto")}


def test_submission_count_treats_lists_as_ordered_and_null_as_a_key(spark, many_partitions):
    df = inclusion.submission_count(
        inclusion.mempool_by_nonce(
            mempool(
                spark,
                sighting(["a", "b"], nonce=1),
                sighting(["a", "b"], nonce=2),
                sighting(["b", "a"], nonce=3),
                sighting([], nonce=4, size=0),
                sighting(None, nonce=5),
                sighting(None, nonce=6),
            )
        )
    )
    assert {r.nonce: r.submission_count for r in df.collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 2, 6: 2}


def test_join_keeps_unmatched_blobs_and_fans_out_over_networks(spark, many_partitions):
    slot = T0 + timedelta(seconds=31)
    df = inclusion.process_rollup(
        mempool(
            spark,
            sighting(["h1", "h1", "h2"], nonce=1, tx="0xa"),
            sighting([], nonce=2, tx="0xb", size=0),
        ),
        sidecars(spark, ("h1", slot, "mainnet"), ("h1", slot, "holesky"), ("h1", slot, "mainnet")),
        "0xS",
    )
    got = sorted((r.hash, r.versioned_hash or "", r.meta_network_name or "") for r in df.collect())
    # the repeated hash and the sidecar copy collapse; the empty list stays as one row
    assert got == [
        ("0xa", "h1", "holesky"),
        ("0xa", "h1", "mainnet"),
        ("0xa", "h2", ""),
        ("0xb", "", ""),
    ]
    assert all(r.num_block_inclusion in (None, 3.0) for r in df.collect())


def test_rolling_mean_spans_networks_and_outliers(spark, many_partitions):
    """60 blobs: the first 49 have no mean, other networks and slow blobs count in it."""
    sightings, found = [], []
    for i in range(60):
        wait = 250 if i == 20 else 2
        slot = T0 + timedelta(hours=2, seconds=12 * i)
        network = "holesky" if i % 10 == 5 else "mainnet"
        seen = slot - timedelta(seconds=12 * wait)
        sightings.append(sighting([f"h{i:02}"], nonce=i, tx=f"0x{i}", seen=seen))
        found.append((f"h{i:02}", slot, network))
    df = inclusion.slot_inclusion(mempool(spark, *sightings), sidecars(spark, *found), ordered=True)
    rows = df.collect()
    assert df.columns == inclusion.INCLUSION_COLUMNS
    assert [r.nonce for r in rows] == [i for i in range(49, 60) if i % 10 != 5]
    mean = (49 * 2 + 250) / 50
    assert all(r.slot_inclusion_rate_50_blob_avg == pytest.approx(mean) for r in rows)
    # an unmatched blob and an empty list change nothing
    more = mempool(spark, *sightings, sighting(["none"], nonce=99), sighting([], nonce=98, size=0))
    assert inclusion.slot_inclusion(more, sidecars(spark, *found), ordered=True).collect() == rows


@pytest.mark.parametrize("blobs", [10, 49, 60, 130])
@pytest.mark.parametrize("unseen", [False, True])
def test_included_blobs_are_the_rows_of_the_general_path(spark, many_partitions, monkeypatch, blobs, unseen):
    """Without the rolling mean the same rows come out, and nothing is range-partitioned."""
    sightings, found = [], []
    for i in range(blobs):
        # several blobs share a slot time
        slot = T0 + timedelta(hours=2, seconds=12 * (i // 3))
        network = "holesky" if i % 10 == 5 else "mainnet"
        seen = slot - timedelta(seconds=12 * (250 if i == 55 else 2))
        sightings.append(sighting([f"h{i:03}"], nonce=i, tx=f"0x{i}", seen=seen, size=0 if i % 7 == 3 else 131072))
        found.append((f"h{i:03}", slot, network))
    pool = mempool(spark, *sightings)
    if unseen:
        # a blob without a first sighting has no rate, and the 49 after it no mean
        pool = pool.withColumn("event_date_time", F.expr("CASE WHEN nonce <> 52 THEN event_date_time END"))
    side = sidecars(spark, *found)
    columns = inclusion.JOINED_SOURCE_COLUMNS
    general = inclusion.slot_inclusion(pool, side).select(*columns)
    plans, stored = [], ordered.materialize
    monkeypatch.setattr(
        ordered, "materialize",
        lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, label),
    )
    rows = inclusion.included_blobs(pool, side)
    assert rows.columns == columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, general.collect()))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    if not unseen or blobs < 53:
        assert not any("rangepartitioning" in p for p in plans)


def incl_frame(spark, rows):
    """Rows are (hash, from, rate, submission_count)."""
    df = spark.createDataFrame(
        rows, "hash string, `from` string, slot_inclusion_rate double, submission_count long"
    )
    return df.withColumns(
        {
            "meta_network_name": F.lit("mainnet"),
            "slot": F.lit(1),
            "slot_time": F.lit(T0).cast("timestamp_ntz"),
            "fill_percentage": F.lit(50.0),
            "blob_hashes_length": F.lit(2.0),
        }
    )


def txs_frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.TRANSACTIONS)


def test_bids_are_distinct_per_transaction_and_complete(spark, many_partitions):
    incl = incl_frame(
        spark,
        [
            ("0xa", "0xS", 3.0, 1),
            ("0xa", "0xS", 3.0, 1),
            ("0xa", "0xS", 4.0, 1),
            ("0xb", "0xS", 3.0, 1),
            ("0xc", "0xS", 3.0, 1),
        ],
    )
    txs = txs_frame(
        spark,
        ("0xa", 7, "0x" + b"reth".hex(), 1e10, 21000.0, 2e10, 5e9),
        ("0xb", 8, None, 1e10, 21000.0, 2e10, 5e9),
    )
    got = fees.slot_gas_bidding(incl, txs).collect()
    assert sorted((r.hash, r.slot_inclusion_rate) for r in got) == [("0xa", 3.0), ("0xa", 4.0)]
    assert {r.builder_label for r in got} == {"vanilla_builder_reth"}
    assert list(got[0].asDict()) == fees.GAS_BIDDING_COLUMNS


def test_joined_table_keeps_unknown_senders_and_missing_fees(spark, many_partitions):
    incl = incl_frame(spark, [("0xa", "0xS", 3.0, 1), ("0xb", "0xs", 3.0, 1)])
    txs = txs_frame(spark, ("0xa", 7, "0x00", 1e10, 21000.0, 2e10, 5e9))
    dim = spark.createDataFrame([("0xS", "base")], schemas.SEQUENCERS)
    got = {r.hash: r for r in fees.inclusion_joined(incl, txs, dim).collect()}
    assert got["0xa"].sequencer_names == "base" and got["0xa"].block_number == 7
    assert got["0xb"].sequencer_names is None and got["0xb"].block_number is None
    named = fees.inclusion_with_rollup(incl, dim, case_insensitive=True).collect()
    assert {r.sequencer_names for r in named} == {"base"}


def test_median_counts_every_row(spark, many_partitions):
    rows = [(1.0, "base", p, 10.0) for p in (0.1, 0.1, 0.1, 0.9)] + [(1.0, "base", None, 30.0)]
    df = spark.createDataFrame(
        rows,
        "slot_inclusion_rate double, sequencer_names string,"
        " priority_fee_bid_percent_premium double, base_fee_per_gas double",
    )
    got = fees.slot_gas_groupby(df).collect()
    assert len(got) == 1
    assert got[0].priority_fee_bid_percent_premium == pytest.approx(0.1)
    assert got[0].base_fee_per_gas == pytest.approx(14.0)
