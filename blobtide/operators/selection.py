"""Exact group quantiles by rank selection, without a sort and without a group in one task.

A quantile is the value at one or two ranks of its group. Values are counted per (group, cell), where
cells are ranges of values in ascending order; running counts over the cells of a group tell which one
holds a rank, and the values of that cell alone are cut into new cells. That ends when a cell holds one
value. Every step is an aggregate with map-side combine over cells; what a window or a task sees of
a group is its cells, `CELLS` per power of two in the first step and `CELLS` in later ones, however
many values the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobtide.operators.joins import null_safe_join
from blobtide.scratch import materialize

CELLS = 1024
_FURTHEST = 2_000_000  # beyond the cells of the smallest and largest doubles


def octave_cell(value: Column) -> Column:
    """Cell of a double by sign and logarithm: never smaller for a larger value, NaN last."""
    octave = F.floor(F.log2(F.abs(value)) * CELLS)
    size = F.least(F.greatest(octave, F.lit(-_FURTHEST)), F.lit(_FURTHEST)) + 2 * _FURTHEST
    return (
        F.when(F.isnan(value), F.lit(4 * _FURTHEST))
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _cell_counts(values: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    """Cells with their rows before the first of the next one, and rows of all cells of the key."""
    cells = values.groupBy(*keys, cell.alias("_cell")).agg(
        F.sum("n").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})


def _first_step(values: DataFrame, groups: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Per group and rank that a quantile needs: the cell that holds it, and the rows before that."""
    cells = _cell_counts(values, groups, octave_cell(F.col("_value")))
    last = F.col("_total") - 1
    ranks = [f(last * F.lit(float(q))) for q in quantiles.values() for f in (F.floor, F.ceil)]
    before = F.col("_upto") - F.col("_n")
    held = F.filter(
        F.array_distinct(F.array(*ranks)), lambda r: (before <= r) & (r < F.col("_upto"))
    )
    return cells.select(
        *groups,
        F.col("_total").alias("_n_values"),
        F.explode(held).alias("_rank"),
        "_lo",
        "_hi",
        before.alias("_before"),
    )


def _next_step(values: DataFrame, groups: Sequence[str], wide: DataFrame) -> DataFrame:
    """The same with the values of each cell cut into cells of equal width."""
    keys = [*groups, "_n_values", "_rank", "_base"]
    bounds = wide.select(
        *keys[:-1],
        F.col("_before").alias("_base"),
        F.col("_lo").alias("_from"),
        F.col("_hi").alias("_to"),
    )
    inside = null_safe_join(values, bounds, groups).where(
        (F.col("_value") >= F.col("_from")) & (F.col("_value") <= F.col("_to"))
    )
    share = (F.col("_value") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
    before = F.col("_base") + F.col("_upto") - F.col("_n")
    return (
        _cell_counts(inside, keys, cell)
        .where((before <= F.col("_rank")) & (F.col("_rank") < F.col("_base") + F.col("_upto")))
        .select(*keys[:-1], "_lo", "_hi", before.alias("_before"))
    )


def group_quantiles(
    counts: DataFrame, groups: Sequence[str], quantiles: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group: the groups, `n_values`, a column per entry of `quantiles`.

    `counts` is a stored frame (groups, value, n) without NULL values, as from `value_counts`. NULL
    groups are groups, and NaN is greater than every other value.
    """
    values = counts.withColumn("_value", F.col("value").cast("double"))
    found = materialize(_first_step(values, groups, quantiles), "cells")
    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    done = [found.where(single)]
    while not (wide := found.where(~single)).isEmpty():
        found = materialize(_next_step(values, groups, wide), "cells")
        done.append(found.where(single))
    picked = done[0]
    for part in done[1:]:
        picked = picked.unionByName(part)
    last = F.col("_n_values") - 1
    at = {
        f"_{side}_{name}": F.max(F.when(F.col("_rank") == f(last * F.lit(float(q))), F.col("_lo")))
        for name, q in quantiles.items()
        for side, f in (("low", F.floor), ("high", F.ceil))
    }
    sides = picked.groupBy(*groups, "_n_values").agg(*[c.alias(k) for k, c in at.items()])
    results = []
    for name, q in quantiles.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        part = last * F.lit(float(q)) - F.floor(last * F.lit(float(q)))
        # equal values also where they are infinite
        between = F.when(low.eqNullSafe(high), low).otherwise(low + (high - low) * part)
        results.append(between.alias(name))
    return sides.select(*groups, F.col("_n_values").alias("n_values"), *results)
