import hashlib
import math

import numpy as np
import pytest

from convspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, v string, cluster string"


def plain(rows, k, rounds, dim):
    """Every distance of every round, in plain whole numbers."""
    kept = []
    for i, vec, *_ in rows:
        if vec is None or len(vec) != dim or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in vec]))
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(far(v)[1], []).append(v)
        cs = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(cs)]
    last = [(i, *far(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in last if m == n) for n in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in last]


def awkward(dim):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in centres[i % 5] * (1 + i % 3) + rng.normal(size=dim) * 0.1]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies of one vector
    rows += [rows[3], rows[3], (None, rows[7][1]), (301, [0.0] * dim), (302, [0.0] * dim)]
    rows += [(400, None), (401, []), (402, [1.0] * (dim - 1)), (403, [1.0] * (dim + 1)), (404, [None] + [1.0] * (dim - 1))]
    rows += [(405, [float("nan")] * dim), (406, [float("inf")] + [0.0] * (dim - 1))]
    return [(i, v, "x", "y") for i, v in rows]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_equal_every_distance(spark, k):
    rows = awkward(8)
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), dim=8)
    got = [tuple(r) for r in centroids.cluster(vectors, k=k, rounds=3).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(got, key=key) == sorted(plain(rows, k, 3, 8), key=key)


def test_search_rejects_and_stays_exact():
    rng = np.random.default_rng(1)
    # means and deviations that differ, ties from repeated centroids, the largest components allowed
    c = (rng.normal(size=(40, 64)) * rng.uniform(1, 300, (40, 1)) + rng.uniform(-500, 500, (40, 1))).astype(np.int64)
    c[17] = c[3]
    x = np.concatenate([c[rng.integers(0, 40, 500)] + rng.integers(-60, 60, (500, 64)), c, [[centroids.LIMIT] * 64, [-centroids.LIMIT] * 64]])
    who, d, taken = centroids.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (d == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()
    assert taken < every.size / 3  # most distances are never taken


def test_components_too_large_for_a_long_are_left_out(spark):
    rows = [(1, [1e30, 0.0], "", ""), (2, [0.5, -0.5], "", ""), (3, [65536.0, -65536.0], "", ""), (4, [65536.1, 0.0], "", "")]
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), dim=2)
    assert {r.vec_id: list(r.v) for r in vectors.collect()} == {2: [128, -128], 3: [1 << 24, -(1 << 24)]}


def test_empty_table(spark):
    vectors = centroids.whole_vectors(spark.createDataFrame([], SCHEMA))
    out = centroids.cluster(vectors)
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
