"""Grouped aggregates that carry a text without keeping it in an aggregate's buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.scratch import materialize


def group_with_text(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    values: dict[str, tuple[str, str]],
    stored: bool = False,
) -> DataFrame:
    """Per key: the smallest `text` and `values` as {name: ("sum" | "min" | "avg", column)}.

    An aggregate with a text in its buffer sorts its whole input. Here the text is a key of the
    aggregate that reads the input, which therefore hashes; its result is stored. Usually a key has
    one text and this is the result. If any key has more, its few rows are merged by a second aggregate.
    `stored` says that `df` is small and cheap to read twice, so that nothing needs to be stored.
    """
    parts: list[Column] = []
    for name, (kind, column) in values.items():
        if kind == "avg":
            parts += [F.sum(column).alias(f"_sum_{name}"), F.count(column).alias(f"_n_{name}")]
        else:
            parts.append((F.sum if kind == "sum" else F.min)(column).alias(name))
    rows = df.groupBy(*keys, text).agg(*parts)
    rows = rows if stored else materialize(rows, "groups")
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1")
    if not several.isEmpty():
        merged = [F.min(text).alias(text)]
        for name, (kind, _) in values.items():
            merged += (
                [F.sum(f"_{part}_{name}").alias(f"_{part}_{name}") for part in ("sum", "n")]
                if kind == "avg"
                else [(F.sum if kind == "sum" else F.min)(name).alias(name)]
            )
        rows = rows.groupBy(*keys).agg(*merged)
    return rows.select(
        *keys,
        text,
        *[
            F.try_divide(f"_sum_{name}", f"_n_{name}").alias(name) if kind == "avg" else F.col(name)
            for name, (kind, _) in values.items()
        ],
    )
