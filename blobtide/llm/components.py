"""Connected components of a link table, by repeated joins on the shared store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them. Edges have u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    `edges` has bigint columns u and v. Large-star and small-star steps alternate until the links
    are a star around each smallest node. Every step is stored, so a lost executor costs one step;
    links never reach the driver, which only sees two sums a round.
    """
    now = stored(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        seen = now.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum"),
        ).first()
        if (seen["n"], seen["sum"]) == mark or seen["n"] == 0:
            break
        mark = (seen["n"], seen["sum"])
        now = stored(_small_star(_large_star(now)), "links")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
