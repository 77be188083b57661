"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The time of an event, and the day it is filed under in tables laid out by day.
EVENT_TIME, EVENT_DATE = "event_date_time", "event_date"

# Microseconds are kept, and quotes are doubled as most CSV readers expect.
_CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_cached(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write Parquet, optionally partitioned by columns.

    Rows are rebalanced on the partition columns first: small partitions share a file and a
    large one is split over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_cached(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Read Parquet. With a schema, columns keep its order and partition values its types."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if schema is not None:
        df = df.select(*[F.col(f"`{name}`") for name in schema.fieldNames()])
    return df if where is None else df.where(where)


def write_days(
    df: DataFrame, path: str, moment: str = EVENT_TIME, mode: str = "errorifexists"
) -> None:
    """Write an event table laid out by day: one folder per date of `moment`.

    Mode `overwrite` replaces only the days that `df` has, so that a refresh can rewrite the last
    ones; `append` adds files to them. Days are rebalanced like any other partition.
    """
    by_day = df.withColumn(EVENT_DATE, F.to_date(F.col(f"`{moment}`")))
    by_day.hint("rebalance", EVENT_DATE).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(EVENT_DATE).parquet(path)


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an event table, laid out by day or not.

    If it is, the day follows the columns of the schema. The folder names alone tell which files
    belong to a day, so a filter on it decides which of them are opened.
    """
    df = spark.read.schema(schema).parquet(path)
    day = [F.col(EVENT_DATE).cast("date")] if EVENT_DATE in set(df.columns) - set(schema.names) else []
    return df.select(*[F.col(f"`{name}`") for name in schema.fieldNames()], *day)


# What stands for a backslash and for line breaks in a CSV file of this library.
_BACKSLASH, _NEWLINE, _RETURN = r"\s", r"\n", r"\r"


def _escaped(text: Column) -> Column:
    """Text without line breaks. Every backslash in it begins one of the three escapes."""
    marked = F.replace(text, F.lit("\\"), F.lit(_BACKSLASH))
    return F.replace(F.replace(marked, F.lit("\n"), F.lit(_NEWLINE)), F.lit("\r"), F.lit(_RETURN))


def _unescaped(text: Column) -> Column:
    """The escapes do not overlap, so they can be undone one kind after the other."""
    broken = F.replace(F.replace(text, F.lit(_NEWLINE), F.lit("\n")), F.lit(_RETURN), F.lit("\r"))
    return F.replace(broken, F.lit(_BACKSLASH), F.lit("\\"))


def _on_strings(df: DataFrame, schema: T.StructType, change) -> DataFrame:
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    return df.select(
        *[
            change(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c
            for c, f in zip(columns, schema.fields, strict=True)
        ]
    )


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV with a header. NULL is an empty field and an empty string is quoted.

    Line breaks and backslashes in texts are escaped, so that a line of the file is a row and one
    big file can be read by several tasks.
    """
    rows = _on_strings(df, df.schema, _escaped)
    rows.write.mode(mode).options(**_CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, escaped: bool = True) -> DataFrame:
    """Read CSV as written by `export_csv`, every file in splits.

    With `escaped=False`, for files from elsewhere, fields may hold line breaks and backslashes as they
    are; such a file is read whole by one task.
    """
    # an unquoted empty field reads as the null marker, a quoted one as an empty string
    options = {**_CSV_OPTIONS, "multiLine": not escaped, "nullValue": "\u0000"}
    rows = spark.read.schema(schema).options(**options).csv(path)
    return _on_strings(rows, schema, _unescaped) if escaped else rows
