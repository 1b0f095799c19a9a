"""Clusters of integer vectors against a plain version, and what the pivots spare."""

import hashlib
import math
import random

import numpy as np
import pytest

from roomtable.llm import pivots

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, n int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, e, 1, "c", "d", 2) for i, e in rows], VECTORS)


def plain(rows, count, rounds):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(256 * int(x)) if abs(x) > 1e30 else math.floor(256 * x) for x in map(float, map(np.float32, e))]))
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:count]
    centroids = [q for _, q in seeds]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    long = lambda x: x if x < 2**63 else None
    total = sum(d for d, _ in found)
    by = {k: sum(d for d, c in found if c == k) for k in range(len(centroids))}
    return [(i, k, long(d), long(by[k]), long(total), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found, strict=True)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def drawn(rng, n, spread=0.2):
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(heads)]) for i in range(n)]


@pytest.mark.parametrize("count, n_pivots", [(7, 3), (40, 8), (3, 1)])
def test_clusters_equal_a_plain_version(spark, count, n_pivots):
    rng = random.Random(count)
    rows = drawn(rng, 150)
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [math.nan] * 64), (6, [math.inf] + [0.0] * 63), (None, [0.5] * 64), (9, rows[9][1]), (9, rows[9][1]), (9, [0.25] * 64), (400, [0.0] * 64), (401, [-1 / 512] * 64)]
    rows += odd
    assert rows_of(pivots.clustered(table_of(spark, rows), count, 3, n_pivots)) == sorted(plain(rows, count, 3), key=str)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [*drawn(rng, 20), (50, [6e5] * 64), (51, [-7e5] * 64), (52, [3e38] * 64), (53, [6.5e5] * 64)]
    assert rows_of(pivots.clustered(table_of(spark, rows), 6, 2, 2)) == sorted(plain(rows, 6, 2), key=str)


def test_no_vectors_and_no_ids(spark):
    assert pivots.clustered(table_of(spark, [])).count() == 0
    assert pivots.clustered(table_of(spark, [(None, [1.0] * 64)])).count() == 0
    assert rows_of(pivots.clustered(table_of(spark, [(1, [1.0] * 64)]))) == sorted(plain([(1, [1.0] * 64)], 40, 5), key=str)


def test_bounds_spare_most_distances_and_change_none():
    rng = np.random.default_rng(4)
    heads = rng.integers(-300, 300, (20, 64))
    vectors = heads[rng.integers(0, 20, 2000)] + rng.integers(-40, 40, (2000, 64))
    centroids = heads + rng.integers(-10, 10, heads.shape)
    fixed = heads[:8]
    best, distance, made = pivots.nearest(vectors, pivots.pivot_distances(vectors, fixed), centroids, fixed)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert made < 0.2 * every.size
