"""Centroid clustering against plain rounds in whole numbers, and its edge cases."""

import random
from hashlib import sha256

import numpy as np
import pytest

from tracelake.llm import kd_clusters

ROWS = "vec_id long, embedding array<float>, cluster string"


def brute(rows, params):
    """The rounds in Python integers: (id, cluster, distance) by row, and the centroids."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * params.scale)) for x in v]) for i, v in rows if v is not None and len(v) == params.size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"{params.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[: params.k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(params.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def vectors(rng, n, size, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("size,scale,spread,k,leaf", [(64, 64, 0.05, 16, 4), (2, 1000, 0.3, 7, 3), (3, 4, 0.4, 16, 2), (1, 2, 1.0, 9, 8), (2, 10_000_000, 0.3, 7, 3)])
def test_clusters_equal_brute_force(spark, size, scale, spread, k, leaf):
    rng = random.Random(size)
    rows = vectors(rng, 230, size, spread)
    rows += [(rng.randrange(230), rows[rng.randrange(230)][1]) for _ in range(20)]  # repeated identifiers and vectors
    params = kd_clusters.ClusterParams(k=k, size=size, scale=scale, leaf=leaf, tree=64)
    wanted, centroids = brute(rows, params)
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3)
    found = kd_clusters.cluster(frame, params).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == sorted(wanted)
    inertia = {}
    for _, c, d in wanted:
        inertia[c] = inertia.get(c, 0) + d
    assert all((r.cluster_inertia, r.inertia, r.centroid) == (inertia[r.cluster], sum(inertia.values()), centroids[r.cluster]) for r in found)


def test_trees_prune_and_take_whole_nodes():
    rng = random.Random(5)
    points = np.array([[int(64 * x) for x in v] for _, v in vectors(rng, 1000, 8, 0.01)], np.int32)
    tree = kd_clusters.Tree(points, 16)
    packed = kd_clusters.unpack(kd_clusters.pack(tree), 8)
    centroids = np.array([points[i] for i in range(0, 1000, 90)], np.int64)
    whole = sum(int(n) for _, n, *_ in kd_clusters.assign(*packed, centroids) if n is not None)
    assert whole > 300
    for level, (count, sums, low, high) in enumerate(packed[2]):
        for i, (a, b) in enumerate(zip(packed[1][level], packed[1][level][1:])):
            assert count[i] == b - a and (sums[i] == packed[0][a:b].sum(0)).all() and (low[i] == packed[0][a:b].min(0)).all() and (high[i] == packed[0][a:b].max(0)).all()


def test_edge_rows(spark):
    one = [float(i) for i in range(64)]
    rows = [(1, None, "c"), (2, [], "c"), (3, one[:63], "c"), (4, [None, *one[1:]], "c"), (5, [float("nan"), *one[1:]], "c"), (6, [float("inf"), *one[1:]], "c"), (7, one, "c"), (7, one, "c"), (None, one, None)]
    found = kd_clusters.cluster(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((r.vec_id or 0, r.cluster, r.distance, r.inertia) for r in found) == [(0, 0, 0, 0), (7, 0, 0, 0), (7, 0, 0, 0)]
    assert kd_clusters.cluster(spark.createDataFrame([], ROWS)).collect() == []
    assert kd_clusters.cluster(spark.createDataFrame(rows[:6], ROWS)).collect() == []
    with pytest.raises(Exception, match="beyond 2\\^27"):
        kd_clusters.cluster(spark.createDataFrame([(1, [1e30, *one[1:]], "c")], ROWS)).collect()
