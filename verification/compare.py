"""Compare a Spark result with a DuckDB result: columns, types, and rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from glob import glob
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# Spark type name -> DuckDB type name
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty if nothing does."""
    expected = connection.sql(sql)
    spark_types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    duck_types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    if set(spark_types) != set(duck_types):
        return [f"columns {sorted(spark_types)} != {sorted(duck_types)}"]
    found = [
        f"type of {name}: {kind} != {duck_types[name]}"
        for name, kind in spark_types.items()
        if kind != duck_types[name]
    ]
    left = _rows(df.columns, df.collect())
    right = _rows(expected.columns, expected.fetchall())
    if left != right:
        found.append(f"rows: {left.total()} != {right.total()}")
        found.append(f"only Spark: {list((left - right).items())[:3]}")
        found.append(f"only SQL: {list((right - left).items())[:3]}")
    elif not left:
        found.append("both results are empty")
    return found
