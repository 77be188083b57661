"""Bit-plane clustering against plain integer arithmetic."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from blobtide.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, planes string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest(), centroids.pack(np.array([r[1]]))[0].view(np.int64).tolist()))
    middles = [v for _, v in first[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(middles))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for c in range(len(middles)):
            mine = [v for (_, v), n in zip(kept, found, strict=True) if n == c]
            if mine:
                middles[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, n in last if n == c) for c in range(len(middles))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, n, d, inertia[n], sum(inertia), digest[n]) for i, d, n in last), key=str)


def vectors(n, seed=1, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_dot_products_equal_plain_ones():
    r = np.random.default_rng(3)
    for reach in (1, 2, 100, 2**20):
        a, b = r.integers(-reach, reach, (2, 50, 64))
        a[0], b[0] = -reach, reach - 1
        words = centroids.pack(a)
        assert (centroids.norms(words) == (a * a).sum(1)).all()
        assert (centroids.component_sums(words) == a.sum(0)).all()
        for row in centroids.pack(b):
            values = np.array(centroids.unpack(row.view(np.int64).tolist()))
            assert (centroids.dots(words, row) == a @ values).all()
    with pytest.raises(ValueError, match="bits"):
        centroids.pack(np.full((1, 64), 2**30))


def test_clusters_equal_brute_force(spark):
    rows = vectors(150)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [math.nan] + [0.0] * 63, [math.inf] * 64, [-math.inf] + [0.0] * 63]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    # ties, repeated rows, one vector that is very common, a null id, one id with two vectors, zeros, wide values
    rows += [rows[0]] * 40 + [(None, rows[1][1]), (3, rows[5][1]), (2000, [0.0] * 64), (2001, [-0.0] * 64), (2002, [300.0] * 64)]
    got = centroids.centroid_clusters(table(spark, rows), k=5, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3)
    got = centroids.centroid_clusters(table(spark, rows), k=16)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 16, 3)
    for empty in ([], [(1, None)], [(1, [math.nan] * 64)]):
        out = centroids.centroid_clusters(table(spark, empty) if empty else spark.createDataFrame([], SCHEMA))
        assert out.collect() == [] and out.dtypes == got.dtypes


def test_one_task_and_many_give_the_same(spark):
    rows = vectors(120, seed=9, spread=0.1)
    one = centroids.centroid_clusters(table(spark, rows).coalesce(1))
    many = centroids.centroid_clusters(table(spark, rows).repartition(17))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
