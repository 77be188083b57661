"""Rank selection, text keys, Bloom filters and one-pass pivots."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from blobtide.operators import bloom, grouping, pivots, selection
from blobtide.operators.quantiles import value_counts
from blobtide.plans import fees


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def quantile(values, q):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    rank = (len(values) - 1) * q
    low, high = values[math.floor(rank)], values[math.ceil(rank)]
    return low if low == high else low + (high - low) * (rank - math.floor(rank))


def test_quantiles_equal_sorting(spark, many_partitions):
    r = random.Random(4)
    data = {
        "uniform": [r.random() for _ in range(3000)],
        "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(2001)],
        "close": [1.0 + i * 2.0**-52 for i in range(1500)],
        "ties": [0.125] * 900 + [0.25] * 901 + [0.0, -0.0],
        "one": [7.5],
        "two": [1.0, 2.0],
        "tiny": [5e-324 * i for i in range(40)],
        "ends": [-math.inf, -1.0, 0.0, 3.0, math.inf, math.inf, math.inf],
        None: [float(i) for i in range(-50, 51)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    counts = value_counts(df.repartition(5), ["g"], "v")
    wanted = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {x.g: x for x in selection.group_quantiles(counts, ["g"], wanted).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        assert got[g].n_values == len(values)
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(quantile(values, q), rel=1e-15, abs=0), (g, name)


def test_no_task_holds_a_group(spark, many_partitions, monkeypatch):
    plans, materialize = [], selection.materialize

    def noted(df, label):
        plans.append(plan_of(df))
        return materialize(df, label)

    monkeypatch.setattr(selection, "materialize", noted)
    n = 300_000
    counts = spark.range(n, numPartitions=8).select(
        F.lit("hot").alias("g"), (F.col("id") * 7919 % n / 3.0).alias("value"), F.lit(1).cast("bigint").alias("n")
    )
    got = selection.group_quantiles(counts, ["g"], {"median": 0.5}).first()
    assert got.median == pytest.approx((n - 1) / 6)
    assert not any("percentile" in p or "collect" in p for p in plans)
    # a group reaches windows as cells only: partial sums come first
    assert all("Window" not in p or "partial_sum" in p for p in plans)


def test_order_of_cells_is_that_of_values(spark):
    r = random.Random(1)
    values = [r.choice([-1, 1]) * 2.0 ** r.uniform(-1074, 1023) for _ in range(3000)]
    values += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = df.select("v", selection.octave_cell(F.col("v")).alias("c")).orderBy("v").collect()
    assert all(a.c <= b.c for a, b in zip(cells, cells[1:], strict=False))
    assert math.isnan(cells[-1].v) and cells[-1].c > cells[-2].c


def test_medians_of_fee_ratios(spark, many_partitions):
    r = random.Random(8)
    rows = [(float(r.randrange(4)), r.choice("ab"), round(r.random(), 3), r.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "slot_inclusion_rate double, sequencer_names string, priority_fee_bid_percent_premium double, base_fee_per_gas double")
    got = fees.slot_gas_groupby(df).collect()
    assert len(got) == 8
    for x in got:
        mine = [v for v in rows if v[:2] == (x.slot_inclusion_rate, x.sequencer_names)]
        assert x.priority_fee_bid_percent_premium == pytest.approx(statistics.median(v[2] for v in mine))
        assert x.base_fee_per_gas == pytest.approx(statistics.mean(v[3] for v in mine))


TEXT_SCHEMA = "k int, t string, v double, w bigint"
VALUES = {"s": ("sum", "w"), "least": ("min", "v"), "mean": ("avg", "v")}


def test_group_with_text(spark, many_partitions):
    rows = [(k, f"t{k}", float(i), i) for k in range(5) for i in range(4)] + [(9, None, 1.0, 1), (None, "n", 2.0, 2)]
    one = grouping.group_with_text(spark.createDataFrame(rows, TEXT_SCHEMA), ["k"], "t", VALUES)
    assert "SortAggregate" not in plan_of(one)
    got = {r.k: (r.t, r.s, r.least, r["mean"]) for r in one.collect()}
    assert got[3] == ("t3", 6, 0.0, 1.5) and got[9] == (None, 1, 1.0, 1.0) and got[None] == ("n", 2, 2.0, 2.0)
    rows += [(3, "a", 10.0, 5), (9, "z", None, 5), (4, None, None, None)]
    several = grouping.group_with_text(spark.createDataFrame(rows, TEXT_SCHEMA), ["k"], "t", VALUES)
    got = {r.k: (r.t, r.s, r.least, r["mean"]) for r in several.collect()}
    assert got[3] == ("a", 11, 0.0, 16 / 5) and got[9] == ("z", 6, 1.0, 1.0) and got[4] == ("t4", 6, 0.0, 1.5)
    assert several.columns == one.columns == ["k", "t", "s", "least", "mean"]


def test_bloom_filter_drops_rows_below_the_shuffle(spark, many_partitions):
    wanted = spark.range(0, 3000, 3).select(F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 10 != 9, F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256))).alias("hash")
    )
    left = bloom.prefilter(rows, wanted, "hash", least_keys=0)
    kept = {r.id for r in left.collect()}
    members = {i for i in range(0, 3000, 3) if i % 10 != 9}
    assert members <= kept and len(kept - members) < 0.05 * 20_000
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        joined = left.join(wanted, "hash")
        plan = plan_of(joined)
        assert {r.id for r in joined.collect()} == members
    finally:
        spark.conf.set(key, before)
    # the test stands between the scan and the exchange of the join
    lines = plan.splitlines()
    test = next(i for i, line in enumerate(lines) if "Filter" in line and "getbit" in line)
    assert any("Exchange hashpartitioning(hash" in line for line in lines[:test])
    assert bloom.prefilter(rows, wanted, "hash") is rows
    assert bloom.bloom_bits(wanted, "hash", bloom.MOST_BITS) is None


def test_fees_are_the_same_with_a_bloom_filter(spark, monkeypatch):
    from functools import partial

    incl = spark.range(400).select(
        F.concat(F.lit("0x"), F.col("id").cast("string")).alias("hash"), F.lit("0xS").alias("from"),
        F.lit("mainnet").alias("meta_network_name"), (F.col("id") % 5).cast("double").alias("slot_inclusion_rate"),
        F.lit(1).cast("bigint").alias("submission_count"),
    )
    txs = spark.range(300, 5000).select(
        F.concat(F.lit("0x"), F.col("id").cast("string")).alias("hash"), F.col("id").alias("block_number"),
        F.lit("0x7265").alias("extra_data"),
        *[F.lit(v).alias(c) for c, v in (("base_fee_per_gas", 1e9), ("gas_used", 21000.0), ("effective_gas_price", 2e9), ("max_priority_fee_per_gas", 1e9))],
    )
    plain = sorted(map(tuple, fees.slot_gas_bidding(incl, txs).collect()))
    monkeypatch.setattr(fees, "prefilter", partial(bloom.prefilter, least_keys=0))
    assert sorted(map(tuple, fees.slot_gas_bidding(incl, txs).collect())) == plain and len(plain) == 100


def test_pivot_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("id % 7 AS r", "id % 4 AS c", "double(id) AS v")
    counted_rows = df.mapInArrow(counted, df.schema)
    cells = pivots.pivot_cells(counted_rows, ["r"], "c", F.max("v"))
    values = pivots.pivot_columns(cells, "c")
    got = pivots.pivoted(cells, ["r"], "c", values, lambda c: f"c{c}").orderBy("r").collect()
    assert values == [0, 1, 2, 3] and seen.value == 1000
    for row in got:
        for c in values:
            assert row[f"c{c}"] == max(float(i) for i in range(1000) if i % 7 == row.r and i % 4 == c)
    assert pivots.pivoted(cells, ["r"], "c", []).count() == 7
