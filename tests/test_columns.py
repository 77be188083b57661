from datetime import datetime

import pytest
from pyspark.sql import functions as F

from blobtide.functions import columns as C


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("value", "text"),
    [
        ("0x67657468", "geth"),
        ("0x47E9", "Gé"),  # latin-1 byte above 0x7f
        ("0x", ""),
        ("0x123", "invalid_hex"),
        ("0xzz", "invalid_hex"),
        (None, None),
    ],
)
def test_hex_to_text(spark, value, text):
    assert evaluate(spark, C.hex_to_text(F.lit(value).cast("string"))) == text


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("geth go1.22", "vanilla_builder_geth"),
        ("reth/v0.2.0", "vanilla_builder_reth"),
        ("reth and geth", "vanilla_builder_geth"),
        ("rsync-builder.xyz", "rsync_builder"),
        ("Titan", "Titan"),
    ],
)
def test_builder_label(spark, text, label):
    value = "0x" + text.encode("latin-1").hex()
    assert evaluate(spark, C.builder_label(F.lit(value))) == label


def test_builder_label_of_null_is_null(spark):
    assert evaluate(spark, C.builder_label(F.lit(None).cast("string"))) is None


def test_fill_percentage(spark):
    assert evaluate(spark, C.fill_percentage(F.lit(25), F.lit(200))) == 87.5
    assert evaluate(spark, C.fill_percentage(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(
    ("seen", "slots"),
    [
        (datetime(2024, 5, 1, 18, 54, 29), 14.0),
        (datetime(2024, 5, 1, 18, 56, 27), 4.0),
        (datetime(2024, 5, 1, 18, 57, 11), 0.0),
        (datetime(2024, 5, 1, 18, 57, 12), 1.0),  # seen after the slot
    ],
)
def test_slots_between(spark, seen, slots):
    slot = datetime(2024, 5, 1, 18, 57, 11)
    seconds = C.seconds_between(
        F.lit(seen).cast("timestamp_ntz"), F.lit(slot).cast("timestamp_ntz")
    )
    assert evaluate(spark, seconds) == (slot - seen).total_seconds()
    assert evaluate(spark, C.slots_between(seconds)) == slots


def test_fees_use_the_raw_columns(spark):
    row = spark.createDataFrame(
        [(10e9, 21000.0, 12e9, 3e9)],
        "base_fee_per_gas double, gas_used double, effective_gas_price double,"
        " max_priority_fee_per_gas double",
    )
    fees = row.withColumns(C.fee_columns()).first()
    assert fees.base_tx_fee_eth == pytest.approx(2.1e-4)
    assert fees.priority_tx_fee_eth == pytest.approx(4.2e-5)
    assert fees.total_tx_fee_eth == pytest.approx(2.52e-4)
    assert fees.base_fee_per_gas == 10.0
    assert fees.priority_fee_gas == 2.0
    assert fees.priority_fee_bid_percent_premium == 0.25


def test_zero_gas_price_has_no_premium(spark):
    row = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 1.0)],
        "base_fee_per_gas double, gas_used double, effective_gas_price double,"
        " max_priority_fee_per_gas double",
    )
    assert row.withColumns(C.fee_columns()).first().priority_fee_bid_percent_premium is None


def test_mean_timestamp_keeps_microseconds(spark):
    times = [datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 4)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert df.agg(C.mean_timestamp(F.col("t")).alias("v")).first().v == datetime(
        2024, 1, 1, 0, 0, 0, 2
    )
