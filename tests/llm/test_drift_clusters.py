import hashlib

import numpy as np
import pytest

from oeeforge.llm import drift_clusters as c
from oeeforge.llm import vectors

from vector_tables import clustered, frame, odd_rows, whole


def brute(rows, dim=64, clusters=8, rounds=10, seed=3):
    kept = [(i, whole(v, dim)) for i, v, _ in rows if whole(v, dim) is not None]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(members[j]) for col in zip(*members[j])] if j in members else m for j, m in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, k, d in found if k == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), digest[k]) for i, k, d in found), key=str)


@pytest.mark.parametrize("radius", [0.1, 1.0, 4.0])
def test_no_point_of_a_sphere_comes_nearer_than_the_loosening(radius):
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(300):
        dim = int(rng.integers(2, 6))
        centre, old = rng.normal(size=dim) * 3, rng.normal(size=dim) * 3
        new = old + rng.normal(size=dim) * rng.choice([0.05, 0.5, 3])
        bound = c.loosening(centre, radius, old, new)
        step = rng.normal(size=(400, dim))
        x = centre + radius * step / np.sqrt((step * step).sum(1))[:, None] * rng.random((400, 1)) ** rng.choice([0, 0.2, 1])
        nearer = np.sqrt(((x - old) ** 2).sum(1)) - np.sqrt(((x - new) ** 2).sum(1))
        assert nearer.max() <= bound + 1e-9
        less += bound < 0.9 * np.sqrt(((new - old) ** 2).sum())
    assert less > 30


def test_clusters_equal_brute_force(spark):
    x = clustered(3, 400, centres=10)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(17, x[5].tolist(), 1), (17, x[5].tolist(), 1), (None, x[6].tolist(), 1), (None, x[7].tolist(), 1), *odd_rows(), (999, [0.1] * 63, 1)]
    got = c.cluster(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_bounds_spare_scans(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(8, 600, centres=8, spread=0.02))]
    kept, path = c.common.staged(vectors.whole_numbers(frame(spark, rows), 64, "vec_id"), "test")
    found = c.fit(kept, path)
    assert found.scanned[0] == 600 and sum(found.scanned[1:]) < 0.5 * 600 * 9


def test_ties_few_rows_and_empty_tables(spark):
    grid = [(i, [(i % 3) / 4, (i // 3 % 3) / 4], 0) for i in range(40)]
    assert sorted(map(tuple, c.cluster(frame(spark, grid), dim=2).collect()), key=str) == brute(grid, dim=2)
    few = [(i, [i / 2, 0.5, 100.0 * i], 0) for i in range(3)]
    assert sorted(map(tuple, c.cluster(frame(spark, few), dim=3).collect()), key=str) == brute(few, dim=3)
    assert sorted(map(tuple, c.cluster(frame(spark, grid), dim=2, clusters=1, rounds=2).collect()), key=str) == brute(grid, dim=2, clusters=1, rounds=2)
    assert c.cluster(frame(spark, odd_rows())).count() == 0 and c.cluster(frame(spark, grid).limit(0)).count() == 0
