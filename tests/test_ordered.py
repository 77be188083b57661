import random

import pytest
from pyspark.sql import functions as F

from blobtide.operators.distributions import density, density_2d, histogram
from blobtide.operators import ordered
from blobtide.operators.ordered import (
    PIECE,
    after_first,
    cumulative_sum,
    number_rows,
    rolling_mean,
    sorted_pieces,
    with_row_id,
)
from blobtide.operators.quantiles import exact_quantiles, value_counts


def frame(spark, values):
    return spark.createDataFrame(
        list(enumerate(values)), "id int, v double"
    ).repartition(3, "id")


def naive_rolling(values, n, min_periods):
    means = []
    for i in range(len(values)):
        window = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
        means.append(sum(window) / len(window) if len(window) >= min_periods else None)
    return means


@pytest.mark.parametrize(
    ("rows", "n", "min_periods", "block_rows"),
    [(49, 50, 50, 64), (50, 50, 50, 50), (777, 50, 50, 60), (400, 32, 1, 100), (10, 1, 1, 3), (0, 5, 1, 8)],
)
def test_rolling_mean_equals_one_global_window(
    spark, many_partitions, rows, n, min_periods, block_rows
):
    rng = random.Random(rows)
    values = [None if rng.random() < 0.1 else float(rng.randrange(100)) for _ in range(rows)]
    got = rolling_mean(
        frame(spark, values), ["id"], {"v": "mean"}, n, min_periods, block_rows=block_rows
    ).collect()
    means = {r.id: r["mean"] for r in got}
    assert len(got) == rows and len(means) == rows
    for i, expected in enumerate(naive_rolling(values, n, min_periods)):
        assert means[i] == (None if expected is None else pytest.approx(expected))


def test_ordered_rolling_mean_leaves_rows_in_order(spark, many_partitions):
    df = rolling_mean(
        frame(spark, [1.0] * 500), ["id"], {"v": "mean"}, 5, block_rows=40, ordered=True
    )
    assert df.rdd.getNumPartitions() > 1
    assert [r.id for r in df.collect()] == list(range(500))


def test_pieces_follow_the_order_when_one_time_holds_most_rows(spark, many_partitions):
    # 90% of the rows share the first order column; the second tells them apart
    df = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(777).alias("time"), "id"
    )
    pieces = sorted_pieces(df, ["time", "id"])
    sizes = [r["count"] for r in pieces.groupBy(PIECE).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1200
    got = {(r.time, r.id): r._row for r in number_rows(df, ["time", "id"]).collect()}
    expected = sorted((i if i % 10 == 0 else 777, i) for i in range(2000))
    assert got == {key: n for n, key in enumerate(expected)}


def test_cumulative_sum(spark, many_partitions):
    rng = random.Random(1)
    values = [None if i % 7 == 3 else float(rng.randrange(50)) for i in range(500)]
    got = cumulative_sum(frame(spark, values), ["id"], {"v": "total"})
    assert got.columns == ["id", "v", "total"]
    totals, running = {r.id: r.total for r in got.collect()}, 0.0
    for i, v in enumerate(values):
        running += v or 0.0
        assert totals[i] == (None if v is None else running)


def test_exact_quantiles(spark, many_partitions):
    rng = random.Random(2)
    data = {"a": [float(rng.randrange(40)) for _ in range(301)], "b": [1.5], "c": [2.0] * 90 + [9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    quantiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = {
        r.g: r
        for r in exact_quantiles(value_counts(df, ["g"], "v"), ["g"], quantiles).collect()
    }
    for g, values in data.items():
        values = sorted(values)
        assert got[g].n_values == len(values)
        for name, q in quantiles.items():
            rank = (len(values) - 1) * q
            lo = int(rank)
            hi = min(lo + 1, len(values) - 1)
            assert got[g][name] == pytest.approx(
                values[lo] + (values[hi] - values[lo]) * (rank - lo)
            )


def test_histogram_bins(spark, many_partitions):
    df = spark.createDataFrame(
        [("a", float(v)) for v in range(11)] + [("b", 4.0), ("b", 4.0), ("b", None)],
        "g string, v double",
    )
    got = {(r.g, r.bin): r for r in histogram(df, "v", ["g"], 5).collect()}
    assert [got["a", i]["count"] for i in range(5)] == [2, 2, 2, 2, 3]
    assert (got["a", 0].bin_start, got["a", 4].bin_end) == (0.0, 10.0)
    # one distinct value: a unit-wide range around it
    assert (got["b", 0].bin_start, got["b", 4].bin_end) == (3.5, 4.5)
    assert sum(got["b", i]["count"] for i in range(5)) == 2


def test_density_is_close_to_the_sum_of_kernels(spark, many_partitions):
    import math

    rng = random.Random(3)
    values = [rng.gauss(5, 2) for _ in range(400)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    h = 0.5 * sd
    for r in density(df, "v", ["g"], bandwidth=0.5, cells=1024, grid=20).collect():
        exact = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / (
            len(values) * h * math.sqrt(2 * math.pi)
        )
        assert r.density == pytest.approx(exact, abs=2e-4)


def test_density_2d_is_close_to_the_sum_of_kernels(spark, many_partitions):
    import math

    rng = random.Random(4)
    points = [(rng.gauss(0, 1), rng.gauss(3, 2)) for _ in range(200)]
    df = spark.createDataFrame(points, "x double, y double")

    def spread(values):
        mean = sum(values) / len(values)
        return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))

    hx, hy = spread([p[0] for p in points]), spread([p[1] for p in points])
    got = density_2d(df, F.col("x"), F.col("y"), bandwidths=(0.6,), cells=512, grid=8).collect()
    assert len(got) == 64
    for r in got:
        a, b = 0.6 * hx, 0.6 * hy
        exact = sum(
            math.exp(-0.5 * (((r.x - x) / a) ** 2 + ((r.y - y) / b) ** 2)) for x, y in points
        ) / (len(points) * 2 * math.pi * a * b)
        assert r.density == pytest.approx(exact, abs=2e-4)


@pytest.mark.parametrize("kind", ["mean", "sum", "number", "narrow"])
def test_input_runs_once_and_only_keys_are_ordered(spark, many_partitions, monkeypatch, kind):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored, materialize = {}, ordered.materialize

    def noted(df, label):
        stored[label] = df.columns
        return materialize(df, label)

    monkeypatch.setattr(ordered, "materialize", noted)
    df = spark.range(500, numPartitions=4).selectExpr("id", "id % 50 AS t", "double(id) AS v", "repeat('x', 50) AS wide")
    df = (df.drop("wide") if kind == "narrow" else df).mapInArrow(counted, (df.drop("wide") if kind == "narrow" else df).schema)
    if kind == "mean":
        out = rolling_mean(df, ["t", "id"], {"v": "m"}, 5)
    elif kind == "number":
        out = number_rows(df, ["t", "id"])
    else:
        out = cumulative_sum(df, ["t", "id"], {"v": "m"})
    rows = out.collect()
    assert len(rows) == 500 and seen.value == 500
    assert stored["ordered"] == {
        "mean": ["_row_id", "v", "_position"], "sum": ["_row_id", "v", "_position"],
        "number": ["_row_id", "_position"], "narrow": ["id", "t", "v", "_position"],
    }[kind]
    order = sorted(range(500), key=lambda i: (i % 50, i))
    if kind == "number":
        assert {r.id: r._row for r in rows} == {i: k for k, i in enumerate(order)}
    elif kind != "mean":
        total, want = 0.0, {}
        for i in order:
            total += i
            want[i] = total
        assert {r.id: r.m for r in rows} == want


def test_after_first_needs_no_range_exchange(spark):
    df = spark.range(300, numPartitions=4).selectExpr("id % 60 AS t", "id", "'x' AS wide")
    rows = with_row_id(df)
    for n in (0, 1, 49, 300, 500):
        left = after_first(rows, ["t", "id"], n)
        assert "rangepartitioning" not in left._jdf.queryExecution().executedPlan().toString()
        order = sorted(range(300), key=lambda i: (i % 60, i))
        assert sorted(r.id for r in left.collect()) == sorted(order[n:])
