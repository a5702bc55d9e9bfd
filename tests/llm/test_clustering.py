"""K-means with bounds against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(vectors, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [nearest(v) for _, v in kept]
    far = [square(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    return [(i, o, d, sum(e for e, p in zip(far, own, strict=True) if p == o), sum(far), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, far, strict=True)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r[:3])


def check(spark, vectors, **more):
    from docsift.llm.clustering import k_means

    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], SCHEMA).repartition(3)
    got = [tuple(r) for r in k_means(table, **more).collect()]
    assert sorted(got, key=key) == sorted(brute(vectors, **more), key=key)


def test_k_means_against_brute_force(spark):
    """Nulls, wrong sizes, values that aren't finite, repeated rows and ids, negative components."""
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    vectors = [(i, [x + r.gauss(0, 0.7) for x in centres[i % 5]]) for i in range(160)]
    vectors += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63), (505, [math.nan] + [1.0] * 63), (506, [math.inf] * 64), (507, [-math.inf] * 64)]
    vectors += [vectors[3], vectors[3], (4, vectors[9][1]), (None, vectors[20][1]), (600, [1000.25] * 64), (601, [0.0] * 64), (601, [-0.0] * 64)]
    check(spark, vectors)


def test_k_means_with_ties_and_empty_clusters(spark):
    """Copies of a third of all rows and more, ties between centroids, fewer vectors than clusters, none."""
    from docsift.llm.clustering import k_means

    corner = lambda i: [float((i >> b) & 1) for b in range(64)]
    check(spark, [(i, corner(i % 4)) for i in range(60)] + [(100 + i, [0.5] * 64) for i in range(40)])
    check(spark, [(i, corner(i)) for i in range(3)])
    assert k_means(spark.createDataFrame([], SCHEMA)).collect() == []
    assert k_means(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_spare_scans():
    from docsift.llm.clustering import assigned, exact_distances, loosened

    r = np.random.default_rng(2)
    centres = r.integers(-3000, 3000, (6, 64))
    v = centres[r.integers(0, 6, 2000)] + r.integers(-400, 400, (2000, 64))
    cluster, upper, lower, n = assigned(v, np.full(2000, -1), np.full(2000, np.inf), np.zeros(2000), centres)
    assert n == 2000
    for _ in range(8):
        moved = centres + r.integers(-60, 60, centres.shape)
        drift = np.sqrt(((moved - centres) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        upper, lower = loosened(cluster, upper, lower, drift)
        d = np.sqrt(exact_distances(v, moved).astype(float))
        own = d[np.arange(len(v)), cluster]
        d[np.arange(len(v)), cluster] = np.inf
        assert (upper >= own).all() and (lower <= d.min(1)).all()
        centres = moved
        cluster, upper, lower, n = assigned(v, cluster, upper, lower, centres)
        assert n < 200 and np.array_equal(cluster, exact_distances(v, centres).argmin(1))
