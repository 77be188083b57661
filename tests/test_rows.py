import math

from blobtide.operators import rows


def test_drop_null_rows_keeps_nan(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, y string"
    )
    kept = {r.y: r.x for r in rows.drop_null_rows(df).collect()}
    assert kept["a"] == 1.0 and math.isnan(kept["b"]) and len(kept) == 2


def test_fill_numeric_nulls(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (1, 2.0, "a", float("nan"))],
        "i int, d double, s string, n double",
    )
    first, second = rows.fill_numeric_nulls(df).collect()
    assert tuple(first) == (-1, -1.0, None, -1.0)
    assert second.i == 1 and second.s == "a" and math.isnan(second.n)
    assert rows.fill_numeric_nulls(df).dtypes == df.dtypes


def test_explode_list_keeps_empty_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, h array<string>")
    got = sorted((r.k, r.h or "") for r in rows.explode_list(df, "h").collect())
    assert got == [(1, "a"), (1, "b"), (2, ""), (3, "")]


def test_latest_per_key(spark, many_partitions):
    df = spark.createDataFrame(
        [(1, "old", 1), (1, None, 2), (2, "x", 5), (2, "y", 5), (3, "z", 0)],
        "k int, v string, version int",
    )
    got = {r.k: (r.v, r.version) for r in rows.latest_per_key(df, ["k"], "version").collect()}
    assert got == {1: (None, 2), 2: ("y", 5), 3: ("z", 0)}


def test_outlier_filter_is_strict_and_drops_null(spark):
    df = spark.createDataFrame([(199.0,), (200.0,), (None,)], "rate double")
    assert [r.rate for r in rows.outlier_filter(df, "rate", 200).collect()] == [199.0]
