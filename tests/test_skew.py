"""One key with a large share of all rows: joins on it are split, results stay whole."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blobtide.operators.joins import splittable_join
from blobtide.operators.ordered import PIECE, sorted_pieces
from blobtide.operators.rows import latest_per_key
from blobtide.plans import inclusion, propagation

T0 = datetime(2024, 1, 1)
# thresholds scaled down to the size of the test data
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
}


@pytest.fixture
def scaled_down(spark, many_partitions):
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(df):
    """Rows, and the plan that AQE ended with."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def collapsed(spark, n):
    """Every other row carries the same blob list."""
    hot = F.col("id") % 2 == 0
    own = F.concat(F.lit("h"), F.col("id").cast("string"))
    return spark.range(n, numPartitions=8).select(
        F.when(hot, F.array(F.lit("hot"))).otherwise(F.array(own)).alias("versioned_hash"),
        F.col("id").alias("nonce"),
        F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("hash"),
        F.lit(T0).cast("timestamp_ntz").alias("event_date_time_min"),
    )


def test_submission_count_splits_a_hot_list(spark, scaled_down):
    rows, plan = final_plan(inclusion.submission_count(collapsed(spark, 20000)))
    assert "skew=true" in plan
    assert Counter(r.submission_count for r in rows) == {10000: 10000, 1: 10000}


def test_sidecar_join_splits_a_hot_hash_and_spreads_missing_ones(spark, scaled_down):
    blobs = inclusion.explode_blobs(collapsed(spark, 20000))
    # a third of the rows has no hash at all
    blobs = blobs.withColumn("versioned_hash", F.when(F.col("nonce") % 3 != 0, F.col("versioned_hash")))
    sidecars = spark.range(20000).select(
        F.when(F.col("id") == 0, "hot")
        .otherwise(F.concat(F.lit("h"), F.col("id").cast("string")))
        .alias("versioned_hash"),
        (F.col("id") + 5).alias("slot"),
        F.lit(T0 + timedelta(seconds=60)).cast("timestamp_ntz").alias("slot_start_date_time"),
        *[F.lit("x").alias(c) for c in ("block_root", "kzg_commitment", "meta_network_name")],
        *[F.lit(1).alias(c) for c in ("blob_size", "blob_empty_size")],
    )
    rows, plan = final_plan(inclusion.mempool_sidecar_join(blobs, sidecars))
    assert "skew=true" in plan
    assert len(rows) == 20000
    expected = {
        n: None if n % 3 == 0 else 5 if n % 2 == 0 else n + 5 for n in range(20000)
    }
    assert {r.nonce: r.slot for r in rows} == expected


def test_one_slot_with_most_rows_is_cut_into_several_pieces(spark, scaled_down):
    df = spark.range(20000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("slot"), "id"
    )
    sizes = [r["count"] for r in sorted_pieces(df, ["slot", "id"]).groupBy(PIECE).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 4 * 1.6


def test_propagation_join_splits_a_hot_slot(spark, scaled_down):
    """Every sighting but a few is of one slot."""
    n = 20000
    events = spark.range(n, numPartitions=8).select(
        F.lit(T0).cast("timestamp_ntz").alias("event_date_time"),
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(1).alias("slot"),
        F.lit(T0).cast("timestamp_ntz").alias("slot_start_date_time"),
        (F.col("id") % 12500).alias("propagation_slot_start_diff"),
        F.sha2(F.col("id").cast("string"), 256).alias("block"),
        F.col("id").alias("epoch"),
        F.lit("mainnet").alias("meta_network_name"),
        F.lit("teku").alias("meta_consensus_implementation"),
    )
    blocks = spark.range(n).select(
        F.col("id").alias("slot"),
        F.lit(T0).cast("timestamp_ntz").alias("slot_start_date_time"),
        F.lit("b").alias("block"),
        F.lit(5).alias("block_total_bytes_compressed"),
        F.lit(5).alias("execution_payload_transactions_total_bytes_compressed"),
        F.lit("teku").alias("meta_consensus_implementation"),
        F.lit(0).alias("version"),
    )
    # grouped by the join key
    blocks = latest_per_key(blocks, ["slot"], "version")
    spread = spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("kzg_commitment"),
        F.col("id").alias("slot"),
        F.lit("teku").alias("meta_consensus_implementation"),
        *[
            F.lit(T0).cast("timestamp_ntz").alias(c)
            for c in ("min_slot_start_date_time", "first_event_time", "last_event_time")
        ],
        F.lit(0).alias("time_diff_milliseconds"),
        F.lit(0).alias("max_blob_index"),
    )
    sidecars = spread.select(
        "slot",
        F.col("first_event_time").alias("slot_start_date_time"),
        F.lit("r").alias("block_root"),
        "kzg_commitment",
        "meta_consensus_implementation",
        F.lit(0).alias("blob_index"),
        F.lit("v").alias("versioned_hash"),
        F.lit(1).alias("blob_size"),
        F.lit(1).alias("blob_empty_size"),
    )
    rows, plan = final_plan(
        propagation.block_sidecar_joined(events, blocks, spread, sidecars)
    )
    assert plan.count("skew=true") == 2
    assert len(rows) == n and all(r.slot_canonical_blob == r.slot for r in rows)


def test_join_with_a_grouped_side_is_split(spark, scaled_down):
    rows = spark.range(20000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got, plan = final_plan(splittable_join(rows, totals, ["k"], "left"))
    assert "skew=true" in plan
    assert len(got) == 20000 and max(r.n for r in got) == 13333
