"""Pivots whose columns are found in the data, with the input read once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.operators.rows import quoted
from blobtide.scratch import materialize


def pivot_cells(df: DataFrame, rows: Sequence[str], column: str, value: Column) -> DataFrame:
    """One stored row per cell: the row keys, the column key and `value`, an aggregate.

    This is the only step that reads the input. Everything after it depends on the number of cells.
    """
    return materialize(df.groupBy(*rows, column).agg(value.alias("_cell")), "cells")


def pivot_columns(cells: DataFrame, column: str, given: Sequence | None = None) -> list:
    """Values that get a column: all that are found, or the given ones if no other is found.

    NULL gets no column. The values are few (clients, blobs per block) and come to the driver.
    """
    found = {row[0] for row in cells.select(column).distinct().collect()} - {None}
    if given is None:
        return sorted(found)
    if extra := found - set(given):
        raise ValueError(f"{column} has values without a column: {sorted(extra)}")
    return list(given)


def pivoted(
    cells: DataFrame,
    rows: Sequence[str],
    column: str,
    values: Sequence,
    name: Callable[[object], str] = str,
) -> DataFrame:
    """One row per row key and a column per value; row keys without any of them are rows all the same."""
    columns = [
        F.max(F.when(quoted(column) == F.lit(value), F.col("_cell"))).alias(name(value))
        for value in values
    ]
    if not columns:
        return cells.select(*rows).distinct()
    return cells.groupBy(*rows).agg(*columns)
