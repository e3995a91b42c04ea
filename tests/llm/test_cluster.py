import hashlib
import math
import random

import numpy as np
import pytest

from reviewmill.llm import cluster, queries

SF = "/root/testdata/sf0.001"


def by_hand(rows, clusters=40, rounds=5, size=64, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [p for _, p in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def nearest(p):
        return min((sum((x - y) ** 2 for x, y in zip(p, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(nearest(p)[1], []).append(p)
        for k, g in groups.items():
            centroids[k] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *nearest(p)) for i, p in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d, _ in found)
    return [(i, k, d, sum(e for _, e, j in found if j == k), total, sha[k]) for i, d, k in found]


def key(row):
    return [(x is not None, x) for x in row]


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_centroid_clustering(spark, SF)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows), key=key)


def test_odd_vectors_repeats_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 3), 1) for _ in range(4)]) for i in range(200)]
    rows += [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan")] * 4),
             (6, [float("inf")] * 4), (None, [0.0] * 4), (7, [0.0] * 4), (7, [0.0] * 4), (7, [-0.001] * 4)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "vec_id long, embedding array<double>, cluster int, distance string")
    got = cluster.cluster(table.repartition(5), 9, 6, 4, 8).drop("point").collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(rows, 9, 6, 4, 8), key=key)


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [5.0, 2.0]), (2, [5.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for n in (0, 1, 3):
        got = cluster.cluster(table.limit(n), 4, 2, 2).drop("point")
        assert sorted(map(tuple, got.collect())) == sorted(by_hand(rows[:n], 4, 2, 2))
    with pytest.raises(Exception, match="not below"):
        cluster.cluster(spark.createDataFrame([(1, [1e9, 0.0])], table.schema), size=2).collect()


def test_large_components_are_exact():
    points = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    centroids = np.array([[-(1 << 26), 1 << 26], [0, 0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centroids] for p in points]
    assert cluster.squared(points, centroids).tolist() == want


def test_drift_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(4)
    gains = []
    for _ in range(400):
        centre, old, new = rng.normal(size=(3, 3)) * rng.choice([0.1, 1, 5], size=(3, 1))
        radius = rng.choice([0.0, 0.3, 2.0])
        spots = rng.normal(size=(3000, 3))
        spots = centre + radius * spots / np.linalg.norm(spots, axis=1)[:, None]
        seen = (np.linalg.norm(spots - old, axis=1) - np.linalg.norm(spots - new, axis=1)).max()
        full = np.linalg.norm(new - old)
        bound = cluster.drift(centre, radius, old, new)
        assert seen - 1e-9 <= bound <= full + 1e-9
        gains.append((full - bound) / full)
    assert np.mean(gains) > 0.3  # much less than the full drift


def test_bounds_spare_scans():
    rng = np.random.default_rng(2)
    middles = rng.integers(-800, 800, size=(8, 6))
    points = middles[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, size=(4000, 6))
    centroids = points[:8].copy()
    state = (np.zeros(4000, np.int64), np.zeros(4000), np.zeros(4000))
    move, scans = cluster.Move(centroids), []
    for _ in range(8):
        *state, scanned = move.assign(points, *state)
        scans.append(scanned)
        assert (state[0] == cluster.squared(points, move.centroids).argmin(axis=1)).all()
        new = np.stack([points[state[0] == k].sum(0) // max(1, (state[0] == k).sum()) if (state[0] == k).any()
                        else move.centroids[k] for k in range(8)])
        far = np.array([state[1][state[0] == k].max(initial=0) for k in range(8)])
        move = cluster.Move(new, np.sqrt(((new - move.centroids) ** 2).sum(1)),
                            cluster.loosening(move.centroids, new, far))
    assert scans[0] == 4000 and scans[-1] < 1000
