import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k, rounds, dims):
    points = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows
              if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1]))
    centroids = [p for _, p in order[:k]]

    def nearest(p):
        return min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centroids[c])), c))

    for _ in range(rounds):
        own = [nearest(p) for _, p in points]
        for c in range(len(centroids)):
            members = [p for (_, p), o in zip(points, own) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    rows = [(i, nearest(p), p) for i, p in points]
    return [(i, c, sum((a - b) ** 2 for a, b in zip(p, centroids[c]))) for i, c, p in rows], centroids


@pytest.mark.parametrize("seed,dims,spread", [(0, 4, 0.02), (1, 8, 0.3), (2, 2, 1.0), (3, 3, 0.0)])
def test_rounds_are_those_of_plain_scans(spark, seed, dims, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    rows = [(i, (middles[rng.integers(6)] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = clustering.clustered(frame, k=5, rounds=6, dims=dims)
    expected, centroids = brute(rows, 5, 6, dims)
    assert found.centroids == centroids
    assert sorted(map(tuple, found.rows().select("vec_id", "cluster", "distance").collect())) == sorted(expected)
    assert sum(found.inertia) == sum(d for *_, d in expected)


def test_bounds_spare_most_scans_of_separate_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (10.0 * np.eye(8)[i % 8] + 0.1 * rng.normal(size=8)).tolist()) for i in range(800)]
    found = clustering.clustered(spark.createDataFrame(rows, SCHEMA), k=3, rounds=5, dims=8)
    assert found.scanned[0] == 800 and found.scanned[-1] < 100


def test_loosening_is_above_what_points_of_the_sphere_show_and_below_full_drift():
    rng = np.random.default_rng(6)
    below = 0
    for _ in range(200):
        dims = int(rng.integers(2, 6))
        old = rng.normal(size=(4, dims)) * 10
        new = old + rng.normal(size=(4, dims)) * rng.uniform(0.01, 5)
        radius = rng.uniform(0, 8, 4)
        loose = clustering.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        for a in range(4):
            others = [j for j in range(4) if j != a]
            way = rng.normal(size=(400, dims))
            points = old[a] + radius[a] * way / np.linalg.norm(way, axis=1)[:, None]
            nearer = max((np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)).max() for j in others)
            full = max(drift[j] for j in others)
            assert nearer <= loose[a] + 1e-9 and loose[a] <= full * (1 + 1e-6)
            below += loose[a] < 0.9 * full
    assert below > 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (None, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [nan, 0.0]),
            (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (9, [-0.0001, -1.0]), (10, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit(1)).withColumn("points", F.lit(2))
    found = clustering.clustered(frame, k=8, rounds=3, dims=2)
    assert len(found.centroids) == 6  # 6 vectors are kept
    assert sorted(r["vec_id"] or 0 for r in found.report().collect()) == [0, 1, 1, 2, 9, 10]
    report = found.report().collect()
    assert {r["inertia"] for r in report} == {sum(found.inertia)}
    assert all(r["cluster_inertia"] == found.inertia[r["cluster"]] for r in report)
    none = clustering.clustered(frame.limit(0), dims=2)
    assert none.report().columns == found.report().columns and none.report().collect() == []
    assert clustering.clustered(frame, k=1, rounds=2, dims=2).rows().count() == 6


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 1, 1])]
    expected, _ = brute(rows, 3, 4, 1)
    found = clustering.clustered(spark.createDataFrame(rows, SCHEMA), k=3, rounds=4, dims=1)
    assert sorted(map(tuple, found.rows().select("vec_id", "cluster", "distance").collect())) == sorted(expected)


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [2.0**18])], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        clustering.clustered(frame, dims=1)
