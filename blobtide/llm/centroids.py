"""Centroid clustering of 64-component vectors by bit-plane popcounts.

A vector of 64 integers is packed into one 64-bit word per bit of its two's complement: word p holds
bit p of all components. The dot product of two vectors is then the sum over pairs of planes of
weight x weight x popcount(plane AND plane), where plane p weighs 2^p and the sign plane -2^p. All of it is
integer arithmetic, so dot products, squared distances and sums are exact, and a vector of bytes
takes 64 bytes instead of 256.

Packed vectors are written once. Each round is one scan of them: a task assigns its vectors and returns
one row of sums per cluster, Spark adds the rows up, and only the centroids (`k` rows) reach the driver.

Defined results: a vector that is null, has another number of components, or a null, NaN or infinite one
is left out. Repeated rows count and are returned as often as they occur. A null id is kept; it is
never a starting centroid before rows with an id. Rows of one id are ordered by their components when
centroids are chosen. Fewer than `k` vectors give fewer centroids, an empty table an empty result.
Other columns are not read. Integers of 28 bits or more raise, since squared distances could leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import stored

COMPONENTS = 64
SCALE = 64
MOST_PLANES = 28
_PACKED = "vec_id bigint, planes array<bigint>, norm bigint"


def kept_integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), or null for a vector that is left out."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(wide) == COMPONENTS) & finite, F.transform(wide, lambda x: F.floor(x * scale)))


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane is worth; the last plane holds the sign."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(values: np.ndarray) -> np.ndarray:
    """(rows, 64) integers as (rows, planes) words, with as many planes as the widest value needs."""
    widest = np.maximum(values, ~values).max(initial=0)
    planes = int(widest).bit_length() + 1
    if planes > MOST_PLANES:
        raise ValueError(f"components of {planes} bits: squared distances could leave 64 bits")
    words = np.empty((len(values), planes), np.uint64)
    for p in range(planes):
        bits = ((values >> p) & 1).astype(np.uint8)
        words[:, p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return words


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot product of each packed row with one packed vector."""
    mine, total = weights(planes.shape[1]), np.zeros(len(planes), np.int64)
    for word, weight in zip(other, weights(len(other)), strict=True):
        if word:
            total += weight * (np.bitwise_count(planes & word) @ mine)
    return total


def norms(planes: np.ndarray) -> np.ndarray:
    """Dot product of each packed row with itself."""
    w, total = weights(planes.shape[1]), np.zeros(len(planes), np.int64)
    for p in range(planes.shape[1]):
        total += w[p] * (np.bitwise_count(planes & planes[:, p : p + 1]) @ w)
    return total


def component_sums(planes: np.ndarray) -> np.ndarray:
    """Sum of each component over all rows."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little")
    counts = bits.reshape(len(planes), -1, COMPONENTS).sum(axis=0, dtype=np.int64)
    return weights(planes.shape[1]) @ counts


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equally near ones) and the squared distance."""
    best, cluster = None, np.zeros(len(planes), np.int32)
    for k, centroid in enumerate(pack(centroids)):
        distance = norm - 2 * dots(planes, centroid) + int((centroids[k] ** 2).sum())
        if best is None:
            best = distance
        else:
            closer = distance < best
            cluster[closer], best[closer] = k, distance[closer]
    return cluster, best


def _packed_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Planes and norms of a batch. Rows packed with fewer planes than others get copies of their sign plane."""
    lists = batch.column("planes")
    words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.minimum(np.arange(lengths.max(initial=1))[None, :], lengths[:, None] - 1) + starts[:, None]
    return words[at], batch.column("norm").to_numpy(zero_copy_only=False)


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Kept vectors as (vec_id, planes, norm)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            words = pack(values)
            offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64).ravel())), pa.array(norms(words))],
                names=["vec_id", "planes", "norm"],
            )

    kept = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), kept_integers(F.col(f"`{vector_col}`"), scale).alias("values")
    )
    return kept.where(F.col("values").isNotNull()).mapInArrow(rows, _PACKED)


def unpack(planes: list[int]) -> list[int]:
    """The integers of one packed vector."""
    words = np.array(planes, np.int64).view(np.uint64).reshape(1, -1)
    return [int(x) for x in component_sums(words)]


def starting_centroids(vectors: DataFrame, k: int, seed: str = "1") -> list[list[int]]:
    """The `k` packed vectors with the smallest hash of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "planes").orderBy(F.col("key").asc_nulls_last(), "planes").limit(k)
    return [unpack(row["planes"]) for row in first.collect()]


def _partial_sums(centroids: np.ndarray):
    """Per task and cluster: rows, sum of distances, sum of each component."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            planes, norm = _packed_rows(batch)
            cluster, distance = nearest(planes, norm, centroids)
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += mine.sum()
                inertia[c] += distance[mine].sum()
                sums[c] += component_sums(planes[mine])
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * COMPONENTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(inertia), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))],
            names=["cluster", "n", "inertia", "sums"],
        )

    return rows


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (rows, sum of squared distances, sum of each component); at most `k` rows are collected."""
    partial = vectors.mapInArrow(_partial_sums(centroids), "cluster int, n bigint, inertia bigint, sums array<bigint>")
    added = partial.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(COMPONENTS)]
    )
    return {row["cluster"]: (row["n"], row["inertia"], [row[f"s{j}"] for j in range(COMPONENTS)]) for row in added.collect()}


@dataclass(frozen=True)
class Clustering:
    """Vectors with the centroids they were last assigned to."""

    vectors: DataFrame
    centroids: list[list[int]]
    inertia: list[int]  # of each cluster

    def assignments(self) -> DataFrame:
        """Per vector: vec_id, cluster, distance (squared)."""
        if not self.centroids:
            return self.vectors.select("vec_id", F.lit(0).alias("cluster"), F.col("norm").alias("distance"))
        centroids = np.array(self.centroids, np.int64)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                cluster, distance = nearest(*_packed_rows(batch), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

        return self.vectors.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint")

    def per_cluster(self, values: list) -> Column:
        """The value of each row's cluster."""
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")) if values else F.lit(None)

    def digests(self) -> list[str]:
        return [sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> Clustering:
    """`rounds` of assigning every vector and moving each non-empty centroid to the floor of its mean."""
    planes = stored(packed(vectors, id_col, vector_col, scale), "planes")
    centroids = starting_centroids(planes, k, seed)
    if not centroids:
        return Clustering(planes, [], [])
    for _ in range(rounds):
        for c, (n, _, sums) in cluster_sums(planes, np.array(centroids, np.int64)).items():
            if n:
                centroids[c] = [s // n for s in sums]
    last = cluster_sums(planes, np.array(centroids, np.int64))
    return Clustering(planes, centroids, [last[c][1] for c in range(len(centroids))])


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(vectors, k, rounds, seed)
    return found.assignments().select(
        "vec_id",
        "cluster",
        "distance",
        found.per_cluster(found.inertia).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("bigint").alias("inertia"),
        found.per_cluster(found.digests()).cast("string").alias("centroid_sha256"),
    )
