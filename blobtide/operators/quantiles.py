"""Exact group quantiles that never hold a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.operators.ordered import cumulative_sum
from blobtide.scratch import materialize


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value), NULL values left out, as columns `value` and `n`."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    counts: DataFrame,
    groups: Sequence[str],
    quantiles: dict[str, float],
    stored: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles of each group, one column per entry of `quantiles`.

    `counts` comes from `value_counts`. Its rows are put in (group, value) order over all tasks;
    their running count tells which two values enclose each quantile's rank. `stored` says that
    `counts` is cheap to read twice.
    """
    running = cumulative_sum(counts, [*groups, "value"], {"n": "_upto"}, stored)
    spans = running.groupBy(*groups).agg(
        F.min(F.col("_upto") - F.col("n")).alias("_start"), F.sum("n").alias("n_values")
    )
    group_keys = [f"_g{i}" for i in range(len(groups))]
    # stored, so that the file size tells Spark whether the groups can be broadcast
    spans = materialize(
        spans.select(
            *[F.col(g).alias(k) for g, k in zip(groups, group_keys, strict=True)],
            "_start",
            "n_values",
        ),
        "spans",
    )
    same_group = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, group_keys, strict=True)]
    last = F.col("_upto") - F.col("_start") - 1
    first = last - F.col("n") + 1
    picks = []
    for name, q in quantiles.items():
        rank = (F.col("n_values") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (first <= at) & (at <= last)
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{side}_{name}"))
    results = []
    for name, q in quantiles.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        rank = (F.col("n_values") - 1) * F.lit(float(q))
        results.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return (
        running.join(spans, same_group)
        .groupBy(*groups, "n_values")
        .agg(*picks)
        .select(*groups, "n_values", *results)
    )
