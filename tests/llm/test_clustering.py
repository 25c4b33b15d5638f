"""Sort-means against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import clustering

DDL = "vec_id long, embedding array<double>, label int, cluster string, v string, distance string"


def brute(data, k, rounds, scale=256, length=64):
    kept = [(d[0], [math.floor(scale * x) for x in d[1]]) for d in data if d[1] is not None and len(d[1]) == length and all(x is not None and math.isfinite(x) for x in d[1])]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), clustering.pack(np.array(r[1], object))))
    centroids = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (at, _) in zip(kept, found) if at == c]
            if own:
                centroids[c] = [sum(xs) // len(own) for xs in zip(*own)]
    found = assign()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d in found)
    return [(i, at, d, sum(e for b, e in found if b == at), total, shas[at]) for (i, _), (at, d) in zip(kept, found)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def vectors(seed, n, length=64):
    rng = random.Random(seed)
    return [(i, [rng.choice((-1, 0, 0.5, 1)) * rng.random() for _ in range(length)], 1, "c", "v", "d") for i in range(n)]


def test_against_brute_force(spark):
    data = vectors(1, 150)
    data += [(200, None, 1, "c", "v", "d"), (201, [0.5] * 63, 1, "c", "v", "d"), (202, [0.5] * 63 + [None], 1, "c", "v", "d"), (203, [0.5] * 63 + [math.nan], 1, "c", "v", "d"),
             (204, [0.5] * 63 + [-math.inf], 1, "c", "v", "d"), (205, [], None, None, None, None), data[3], (data[4][0], data[5][1], 1, "c", "v", "d"), (None, data[6][1], None, None, None, None), (None, data[7][1], None, None, None, None)]
    found = [tuple(r) for r in clustering.clusters(spark.createDataFrame(data, DDL).repartition(3)).collect()]
    assert sorted(found, key=key) == sorted(brute(data, 40, 5), key=key)


def test_ties_and_fewer_vectors_than_centroids(spark):
    square = [(i, [float(i % 2)] * 32 + [float(i // 2 % 2)] * 32, 1, "c", "v", "d") for i in range(12)]
    for k in (2, 3, 40):
        found = [tuple(r) for r in clustering.clusters(spark.createDataFrame(square, DDL), k=k, rounds=2).collect()]
        assert sorted(found) == sorted(brute(square, k, 2))


def test_large_components_are_exact(spark):
    data = vectors(3, 60)
    data += [(100 + i, [x * 2.0 ** (10 + i) for x in d[1]], 1, "c", "v", "d") for i, d in enumerate(data[:10])]
    assert sorted(map(tuple, clustering.clusters(spark.createDataFrame(data, DDL), rounds=2).collect())) == sorted(brute(data, 40, 2))
    far = data + [(500, [1e30] * 64, 1, "c", "v", "d"), (501, [-1e30] * 64, 1, "c", "v", "d")]
    want = {r[:2] for r in brute(far, 40, 2)}
    found = clustering.clusters(spark.createDataFrame(far, DDL), rounds=2).collect()
    assert {(r["vec_id"], r["cluster"]) for r in found} == want
    assert all(r["inertia"] is None or r["inertia"] < 2**63 for r in found)


def test_scan_stops_only_beyond_twice_the_distance():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-3, 4, (12, 4))
    rows = rng.integers(-3, 4, (400, 4))
    at, best = clustering.nearest(rows, rng.integers(0, 12, 400), centroids, *clustering.sorted_others(centroids))
    gaps = ((rows[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (at == gaps.argmin(1)).all() and (best == gaps.min(1)).all()


def test_packing():
    for row in ([0, -1, 5], [1 << 40, -3, 2], [10**30, -(10**25), 0], [-(1 << 15), 0, 1], [1 << 62, 0, 0]):
        assert clustering.unpack([clustering.pack(np.array(row, object))])[0].tolist() == row
    assert clustering.whole_numbers(np.array([[-0.001, 0.004, 1e300]]))[0].tolist() == [-1, 1, 256 * int(1e300)]


def test_empty(spark):
    found = clustering.clusters(spark.createDataFrame([], DDL))
    assert found.count() == 0
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.clusters(spark.createDataFrame([(1, [0.1], 1, "c", "v", "d")], DDL)).count() == 0


@pytest.mark.parametrize("k", [1, 7])
def test_other_sizes(spark, k):
    data = vectors(5, 40, 8)
    found = [tuple(r) for r in clustering.clusters(spark.createDataFrame(data, DDL), k=k, rounds=3, scale=16, length=8).collect()]
    assert sorted(found) == sorted(brute(data, k, 3, 16, 8))
