"""Histograms, box statistics and kernel densities.

Rows are first counted per cell, so everything after that first aggregate depends on the number
of cells and groups only, never on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.operators.joins import null_safe_join
from blobtide.operators.quantiles import exact_quantiles, value_counts
from blobtide.scratch import materialize


def cell_index(value: Column, lo: Column, hi: Column, cells: int) -> Column:
    """0-based equal-width cell of `value` in [lo, hi]; the top edge is in the last cell."""
    share = F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.0))
    return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")


def _stored_values(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The value and group columns alone, stored because they are read twice."""
    return materialize(df.where(F.col(value).isNotNull()).select(*groups, value), "values")


def _group_ranges(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    ranges = df.groupBy(*groups).agg(
        F.count(value).alias("_n"),
        F.min(value).cast("double").alias("_lo"),
        F.max(value).cast("double").alias("_hi"),
        F.stddev_samp(value).alias("_sd"),
    )
    return materialize(ranges, "ranges")


def histogram(
    df: DataFrame, value: str, groups: Sequence[str], bins: int = 100
) -> DataFrame:
    """Equal-width histogram of each group over the group's own range, empty bins included."""
    values = _stored_values(df, groups, value)
    ranges = _group_ranges(values, groups, value)
    # a group with one distinct value gets a unit-wide range around it
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(
        *groups,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    counts = (
        null_safe_join(values, ranges, groups)
        .groupBy(*groups, cell_index(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        null_safe_join(
            ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))),
            counts,
            [*groups, "bin"],
            "left",
        )
        .select(
            *groups,
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("count"),
        )
    )


def box_stats(
    df: DataFrame, value: str, groups: Sequence[str], whisker: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers (the furthest values within `whisker` IQRs) and outlier count."""
    counts = materialize(value_counts(df, groups, value), "counts")
    quartiles = materialize(
        exact_quantiles(
            counts, groups, {"q1": 0.25, "median": 0.5, "q3": 0.75}, stored=True
        ),
        "quartiles",
    )
    reach = (F.col("q3") - F.col("q1")) * F.lit(whisker)
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        null_safe_join(counts, quartiles, groups)
        .groupBy(*groups, "n_values", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


# A kernel is cut where it has fallen to exp(-KERNEL_REACH^2 / 2), 1.3e-14 of its height. A density of
# weights that add up to 1 is off by less than that share of one kernel's height.
KERNEL_REACH = 8.0


def _gaussian(at: Column, center: Column, width: Column) -> Column:
    z = F.try_divide(at - center, width)
    return F.exp(F.lit(-0.5) * z * z)


def _position(index: Column, lo: Column, hi: Column, points: int) -> Column:
    """The `index`-th of `points` evenly spaced positions from lo to hi."""
    return lo + index * ((hi - lo) / (points - 1))


def _reached(center: Column, width: Column, lo: Column, hi: Column, points: int) -> Column:
    """Positions that the kernel around `center` reaches, as an array.

    Without a width there is no density anywhere, and with one place only every position is it.
    """
    step = (hi - lo) / (points - 1)
    first = F.greatest(F.ceil(F.try_divide(center - KERNEL_REACH * width - lo, step)), F.lit(0))
    last = F.least(
        F.floor(F.try_divide(center + KERNEL_REACH * width - lo, step)), F.lit(points - 1)
    )
    some = F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))
    indexes = F.when((width > 0) & (step > 0), some).otherwise(every)
    return F.transform(indexes, lambda i: _position(i, lo, hi, points))


def _every(lo: Column, hi: Column, points: int) -> Column:
    """All positions, as an array."""
    indexes = F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))
    return F.transform(indexes, lambda i: _position(i, lo, hi, points))


def _center(index: Column, lo: Column, hi: Column, cells: int) -> Column:
    return lo + (index + 0.5) * (hi - lo) / cells


def density(
    df: DataFrame,
    value: str,
    groups: Sequence[str],
    bandwidth: float | None = None,
    cells: int = 2048,
    grid: int = 512,
) -> DataFrame:
    """Gaussian kernel density of each group at `grid` points over the group's range.

    The kernel width is `bandwidth` standard deviations; by default n^(-1/5) of them. A cell adds to
    the points within `KERNEL_REACH` widths of it, which states the error, and to no other.
    """
    values = _stored_values(df, groups, value)
    ranges = _group_ranges(values, groups, value)
    lo, hi = F.col("_lo"), F.col("_hi")
    factor = F.pow(F.col("_n"), F.lit(-0.2)) if bandwidth is None else F.lit(float(bandwidth))
    counts = (
        null_safe_join(values, ranges, groups)
        .groupBy(*groups, cell_index(F.col(value), lo, hi, cells).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    width = factor * F.col("_sd")
    center = _center(F.col("_cell"), lo, hi, cells)
    kernels = null_safe_join(counts, ranges, groups).select(
        *groups,
        "_n",
        width.alias("_h"),
        "_count",
        center.alias("_at"),
        F.explode(_reached(center, width, lo, hi, grid)).alias("x"),
    )
    added = kernels.select(
        *groups, "_n", "_h", "x", (F.col("_count") * _gaussian(F.col("x"), F.col("_at"), F.col("_h"))).alias("_weight")
    )
    # every point has a row, also where no kernel reaches
    points = ranges.select(
        *groups, "_n", width.alias("_h"), F.explode(_every(lo, hi, grid)).alias("x"), F.lit(0.0).alias("_weight")
    )
    scale = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    return (
        added.unionByName(points)
        .groupBy(*groups, "x", "_n", "_h")
        .agg(F.sum("_weight").alias("_weight"))
        .select(*groups, "x", F.try_divide("_weight", scale).alias("density"))
    )


def density_2d(
    df: DataFrame,
    x: Column,
    y: Column,
    bandwidths: Sequence[float] = (0.1, 1.0),
    cells: int = 256,
    grid: int = 100,
) -> DataFrame:
    """Product-Gaussian density of (x, y) on a `grid` by `grid` lattice, per bandwidth.

    A bandwidth is a number of standard deviations of each axis. The kernel separates: cells are
    smoothed along x, added up per row of cells, then smoothed along y. Each step only adds to the
    points within `KERNEL_REACH` widths, so the work is cells x reach + rows of cells x reach, not
    cells x lattice.
    """
    points = df.select(x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    # stored because it is read twice
    points = materialize(points.where("_x IS NOT NULL AND _y IS NOT NULL"), "points")
    # one row of totals: it fixes the cells of the second pass as literals
    total = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(c).alias(f"{name}{c}")
            for c in ("_x", "_y")
            for name, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))
        ],
    ).first()
    x_lo, x_hi, x_sd = (F.lit(total[k]).cast("double") for k in ("lo_x", "hi_x", "sd_x"))
    y_lo, y_hi, y_sd = (F.lit(total[k]).cast("double") for k in ("lo_y", "hi_y", "sd_y"))
    h_x, h_y = F.col("bandwidth") * x_sd, F.col("bandwidth") * y_sd
    counts = points.groupBy(
        cell_index(F.col("_x"), x_lo, x_hi, cells).alias("_cx"),
        cell_index(F.col("_y"), y_lo, y_hi, cells).alias("_cy"),
    ).agg(F.count(F.lit(1)).alias("_count"))
    widths = F.explode(F.array(*[F.lit(float(b)) for b in bandwidths])).alias("bandwidth")
    center_x = _center(F.col("_cx"), x_lo, x_hi, cells)
    along_x = (
        counts.select("*", widths)
        .withColumn("x", F.explode(_reached(center_x, h_x, x_lo, x_hi, grid)))
        .groupBy("bandwidth", "x", "_cy")
        .agg(F.sum(F.col("_count") * _gaussian(F.col("x"), center_x, h_x)).alias("_smooth"))
    )
    center_y = _center(F.col("_cy"), y_lo, y_hi, cells)
    smoothed = along_x.withColumn(
        "y", F.explode(_reached(center_y, h_y, y_lo, y_hi, grid))
    ).select(
        "bandwidth", "x", "y", (F.col("_smooth") * _gaussian(F.col("y"), center_y, h_y)).alias("_weight")
    )
    # every point of the lattice has a row if there are rows at all
    lattice = (
        df.sparkSession.range(1 if total["n"] else 0)
        .select(widths)
        .select("bandwidth", F.explode(_every(x_lo, x_hi, grid)).alias("x"))
        .select("bandwidth", "x", F.explode(_every(y_lo, y_hi, grid)).alias("y"), F.lit(0.0).alias("_weight"))
    )
    return (
        smoothed.unionByName(lattice)
        .groupBy("bandwidth", "x", "y")
        .agg(F.sum("_weight").alias("_weight"))
        .select(
            "bandwidth",
            "x",
            "y",
            F.try_divide("_weight", F.lit(total["n"]) * F.lit(2 * math.pi) * h_x * h_y).alias(
                "density"
            ),
        )
    )
