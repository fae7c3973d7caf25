"""Centroid clustering against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from counterlift.llm.centroids import LIMIT, centroid_clusters, centroid_digest


def _brute(rows, k, rounds, dim, seed=2):
    grid = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            grid.append((vec_id, [max(-LIMIT, min(LIMIT, math.floor(256 * x))) for x in v]))
    ranked = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in grid if i is not None)
    centroids = [v for _, v in ranked[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        held = {}
        for _, v in grid:
            held.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[i]) for x in zip(*held[i], strict=True)] if i in held else c for i, c in enumerate(centroids)]
    found = [(i, *place(v)) for i, v in grid] if centroids else []
    by = {}
    for _, d, c in found:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), centroids[c]) for i, d, c in found), key=repr)


SHAPE = "vec_id long, embedding array<double>, cluster string, distance string"


@pytest.mark.parametrize("n", [3, 60])
def test_equals_plain_python(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5]) + rng.random() / 4 for _ in range(4)]) for i in range(n)]
    rows += [rows[0], (1, [0.1, 0.2, 0.3, 0.4]), (None, [0.5, 0.5, 0.5, 0.5])]  # a repeated row, a repeated id, no id
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan, 0.0, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(906, [1e300, -1e300, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in centroid_clusters(docs, k=5, rounds=3, dim=4).collect()), key=repr)
    assert got == _brute(rows, 5, 3, 4)


def test_empty_and_unusable_tables_are_empty(spark):
    assert centroid_clusters(spark.createDataFrame([], SHAPE), dim=4).collect() == []
    assert centroid_clusters(spark.createDataFrame([(1, [1.0], "", "")], SHAPE), dim=4).collect() == []


def test_a_long_of_ties_goes_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    out = centroid_clusters(spark.createDataFrame([(*r, "", "") for r in rows], SHAPE), k=10, rounds=2, dim=2)
    assert out.groupBy("distance").count().collect()[0].distance == 0
    assert out.select("cluster").distinct().count() == 2


def test_digest_is_of_decimal_integers(spark):
    row = centroid_clusters(spark.createDataFrame([(7, [-0.5, 0.25], "", "")], SHAPE), dim=2).withColumn(
        "sha", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    ).first()
    assert list(row.centroid) == [-128, 64]
    assert row.sha == centroid_digest([-128, 64]) == hashlib.sha256(b"-128,64").hexdigest()
