import hashlib
import random

import numpy as np
import pytest

from threatlake.llm import centroid_clusters
from threatlake.llm.centroid_clusters import DIM, nearest, rotated

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, lead string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "x", 3) for i, e in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == DIM and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), f) for i, f in kept if i is not None)
    centres = [f for _, f in order[:k]]

    def nearest_of(f):
        return min((sum((x - y) ** 2 for x, y in zip(f, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, f in kept:
            groups.setdefault(nearest_of(f)[1], []).append(f)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest_of(f)) for i, f in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i or -1, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found)


@pytest.mark.parametrize("kind", ["clustered", "noise", "hot", "awkward"])
def test_equals_brute_force(spark, kind):
    r = random.Random(7)
    rows = [(i, [r.gauss(2.0 * (j % 6 == i % 6) if kind != "noise" else 0, 0.4) for j in range(DIM)]) for i in range(150)]
    if kind == "hot":
        rows = [(i, [0.25] * DIM if i % 3 else e) for i, e in rows]
    if kind == "awkward":
        rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [float("nan")] * DIM), (305, [float("-inf")] * DIM)]
        rows += [(306, [1e5] * DIM), (307, [-1e5] * DIM), (None, [0.5] * DIM), (5, [0.1] * DIM), (5, [0.1] * DIM), (308, [1.0] * 65)]
    got = centroid_clusters.cluster(table(spark, rows), 12, 3).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == brute(rows, 12, 3)


def test_few_and_no_vectors(spark):
    assert centroid_clusters.cluster(table(spark, [])).count() == 0
    assert centroid_clusters.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0
    got = centroid_clusters.cluster(table(spark, [(1, [1.0] * DIM), (2, [-1.0] * DIM)])).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got) == [(1, 0, 0), (2, 0, 0)]
    assert centroid_clusters.cluster(table(spark, [(1, [1e30] * DIM)])).count() == 0


def test_bounds_hold_and_leave_most_centroids_out():
    random_ = np.random.default_rng(3)
    centres = random_.normal(0, 200, (40, DIM)).astype(np.int64)
    x = centres[random_.integers(0, 40, 2000)] + random_.normal(0, 60, (2000, DIM)).astype(np.int64)
    mean = x.mean(0)
    _, basis = np.linalg.eigh(np.cov(x.T))
    basis = basis[:, ::-1]
    lead, rest = rotated(x, mean, basis)
    c_lead, c_rest = rotated(centres, mean, basis)
    cluster, best, measured = nearest(x, lead, rest, centres, c_lead, c_rest)
    exact = ((x[:, None, :] - centres) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    low = ((lead[:, None] - c_lead) ** 2).sum(2) + (rest[:, None] - c_rest) ** 2
    assert (low <= exact * (1 + 1e-9) + 1e-3).all()
    assert measured.mean() < 20
