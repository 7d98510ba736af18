import hashlib
import math
import random

import numpy as np
import pytest

from tidewheel.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, x string, number string"


def brute(rows, k, rounds, size, scale=256):
    """Everything in Python's integers: (vec_id, cluster, distance), centroids."""
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centres = [x for _, x in first[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        centres = [[sum(v) // len(m) for v in zip(*m)] if (m := [x for (_, x), o in zip(kept, own) if o == n]) else c for n, c in enumerate(centres)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], centres


def check(spark, rows, k, rounds, size):
    df = spark.createDataFrame([(i, e, "a", "b", "c") for i, e in rows], SCHEMA).repartition(3)
    found, centroids = C.cluster(df, k, rounds, size=size)
    want, centres = brute(rows, k, rounds, size)
    got = found.collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    assert centroids.rows.tolist() == centres
    for r in got:
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_against_integers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    check(spark, rows, 7, 4, 8)


def test_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(i % 90, [float(rng.randrange(-2, 3)) / 256 for _ in range(4)]) for i in range(250)]  # a small grid: ties everywhere
    rows += [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0]), (4, [1.0, float("nan"), 1.0, 1.0]), (5, [1.0, float("inf"), 1.0, 1.0]), (6, [1.0] * 5), (None, [0.5] * 4), (None, [0.5] * 4)]
    rows += [(7, [0.25] * 4)] * 90
    check(spark, rows, 12, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, -2.0])], 9, 2, 2)
    found, centroids = C.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 3, 2)
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and len(centroids.rows) == 0


def test_components_that_float32_cannot_hold(spark):
    base = [3e5, -3e5, 2e5, 1e5]
    rows = [(i, [v + (i * 7 + j) % 5 / 256 for j, v in enumerate(base)]) for i in range(60)]
    check(spark, rows, 5, 2, 4)
    check(spark, [(i, [v * 8 + (i * 7 + j) % 5 for j, v in enumerate(base)]) for i in range(60)], 5, 2, 4)


@pytest.mark.parametrize("spread", [1, 100, 1 << 20])
def test_intervals_hold_the_exact_distances(spread):
    rng = np.random.default_rng(spread)
    x, c = (rng.integers(-spread * 1000, spread * 1000, (n, 64)) for n in (400, 40))
    centroids = C.Centroids(c.tolist())
    low, high = centroids.intervals(x)
    for v in range(0, 400, 7):
        own = sum(int(a) ** 2 for a in x[v])
        for k in range(40):
            exact = sum((int(a) - int(b)) ** 2 for a, b in zip(x[v], c[k])) - own
            assert low[v, k] <= exact <= high[v, k]
    _, least, computed = centroids.nearest(x)
    assert computed < 2 * 400  # the shortlists are short
    assert least.tolist() == [min(sum((int(a) - int(b)) ** 2 for a, b in zip(v, k)) for k in c) for v in x]
