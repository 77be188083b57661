"""Row-level operators: null handling, thresholds, de-duplication, explode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blobtide.operators.joins import null_safe_join
from blobtide.scratch import materialize


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def complete(columns: Iterable[str]) -> Column:
    """None of the columns is NULL. NaN is a value, unlike in `DataFrame.dropna`."""
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL in any column."""
    return df.where(complete(df.columns))


def fill_numeric_nulls(df: DataFrame, value: int = -1, keep: Iterable[str] = ()) -> DataFrame:
    """Fill NULLs of numeric columns; strings, timestamps and `keep` keep theirs. NaN is kept."""
    kept = set(keep)
    return df.selectExpr(
        *[
            f"coalesce(`{f.name}`, CAST({value} AS {f.dataType.simpleString()})) AS `{f.name}`"
            if isinstance(f.dataType, T.NumericType) and f.name not in kept
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def outlier_filter(df: DataFrame, column: str, upper: float) -> DataFrame:
    """Rows strictly below a threshold; NULL does not pass."""
    return df.where(quoted(column) < upper)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def explode_list(df: DataFrame, column: str) -> DataFrame:
    """One row per list element; an empty or NULL list gives one NULL row."""
    return df.withColumn(column, F.explode_outer(column))


def sort_rows(df: DataFrame, *leading: Column) -> DataFrame:
    """Global sort by the leading columns, then by all columns.

    Many rows may share the leading columns; the others let the range partitioning of the sort
    split them over several tasks.
    """
    return df.orderBy(*leading, *[quoted(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key; NULL is the lowest version, and a key of its own.

    Only keys, versions and row hashes are grouped, in fixed-width buffers: a hash aggregate with
    map-side combine, so the versions of a frequent key collapse before the shuffle and no text is
    sorted. What it finds is stored and joined back. Equal rows are returned once. Of different
    rows with the same version the greatest in column order is taken; such keys are told by their
    row hashes and only their rows pass an aggregate over text.
    """
    rest = [c for c in df.columns if c not in keys and c != version]
    # a hash skips NULLs, so where they are is hashed as well
    row = F.xxhash64(F.lit(0), *[quoted(c) for c in rest], *[quoted(c).isNull() for c in rest])
    versions = (
        df.select(*[quoted(c) for c in keys], quoted(version), row.alias("_row"))
        .groupBy(*keys, version)
        .agg((F.min("_row") != F.max("_row")).alias("_tied"))
    )
    newest = materialize(
        versions.groupBy(*keys).agg(
            F.max(version).alias(version),
            F.coalesce(F.max_by("_tied", version), F.max("_tied")).alias("_tied"),
        ),
        "newest",
    )
    single = null_safe_join(df, newest.where(~F.col("_tied")).drop("_tied"), [*keys, version])
    # a filter on the result reaches the rows before this join
    single = single.select(*[quoted(c) for c in df.columns]).distinct()
    if newest.where("_tied").isEmpty():
        return single
    greatest = F.max(F.struct(*[quoted(c) for c in rest])).alias("_greatest")
    rows = null_safe_join(df, newest.where("_tied").drop("_tied"), [*keys, version])
    chosen = [
        F.col(f"_greatest.`{c}`").alias(c) if c in rest else quoted(c) for c in df.columns
    ]
    return single.unionByName(rows.groupBy(*keys, version).agg(greatest).select(*chosen))


def split_labels(condition: Column, when_true: str, when_false: str) -> Column:
    """Label of the side of a two-way split; NULL counts as false."""
    return F.when(condition, when_true).otherwise(when_false)
