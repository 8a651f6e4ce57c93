"""Near vectors, reachability trees and density clusters against plain versions."""

import itertools

import numpy as np
import pytest
from corpusloom.operators import neighbourhoods as nb

SCHEMA = "id bigint, vector array<float>"


def clustered(n, dim=8, seed=2, centres=12):
    r = np.random.default_rng(seed)
    at = r.normal(size=(centres, dim)) * 3
    x = (at[r.integers(centres, size=n)] + r.normal(size=(n, dim)) * 0.12).astype(np.float32)
    x[n - n // 8 :] = x[: n // 8]  # copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)


def distances(x):
    y = x.astype(np.float64)
    return np.sqrt(np.square(y[:, None] - y[None]).sum(2))


def plain_dbscan(x, radius, least):
    d = distances(x) <= radius
    core, root = d.sum(1) >= least, list(range(len(x)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a, b in itertools.combinations(np.flatnonzero(core).tolist(), 2):
        if d[a, b]:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    full, out = distances(x), []
    for i in range(len(x)):
        near = [(full[i, j], j) for j in np.flatnonzero(d[i] & core)]
        out.append(find(i) if core[i] else find(min(near)[1]) if near else None)
    return out


@pytest.mark.parametrize("radius", [0.05, 0.4, 1.0])
def test_pairs_within_a_radius(spark, radius):
    x = np.unique(clustered(300), axis=0)
    d = distances(x)
    want = {(i, j): d[i, j] for i, j in itertools.combinations(range(len(x)), 2) if d[i, j] <= radius}
    rows = nb.within(nb.distinct_points(frame(spark, x)), radius, block=16).collect()
    assert len(rows) == len(want) and all(abs(want[r["a"], r["b"]] - r["dist"]) < 1e-12 for r in rows)


def test_few_pairs_are_compared(spark):
    points = nb.distinct_points(frame(spark, clustered(1500, centres=40)))
    some, every = nb.compared(points, 0.4)
    assert some < every / 10


@pytest.mark.parametrize("radius, least", [(0.25, 4), (0.4, 10), (0.02, 2)])
def test_dbscan(spark, radius, least):
    x = clustered(240)
    got = {r["id"]: r["cluster"] for r in nb.dbscan(frame(spark, x), radius, least).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, radius, least)


def test_tree_and_its_clusters_at_all_heights(spark):
    x, least, radius = clustered(160, dim=4), 4, 2.0
    points, d = frame(spark, x), distances(x)
    cores, tree = nb.reachability(points, radius, least)
    core = np.sort(d, axis=1)[:, least - 1]
    of = {r["id"]: r["core"] for r in cores.collect()}
    assert all(abs(of[i] - core[i]) < 1e-12 if core[i] <= radius else of[i] is None for i in of)
    # The weights of a lightest spanning forest, by Kruskal's rule.
    ids = sorted(i for i in of if of[i] is not None)
    root = {i: i for i in ids}
    find = lambda a: a if root[a] == a else find(root[a])
    weights = []
    for w, a, b in sorted((max(d[a, b], core[a], core[b]), a, b) for a, b in itertools.combinations(ids, 2) if d[a, b] <= radius):
        if find(a) != find(b):
            root[find(a)] = find(b)
            weights.append(w)
    assert np.allclose(sorted(r["weight"] for r in tree.collect()), weights, atol=1e-12)
    for height in (0.15, 0.3):
        got = {r["id"]: r["cluster"] for r in nb.clusters_at(points, cores, tree, height, radius).collect()}
        assert [got[i] for i in range(len(x))] == plain_dbscan(x, height, least)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nb.dbscan(none, 0.5, 2).count() == 0
    few = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (None, [0.0]), (4, None), (5, [9.0])], SCHEMA)
    got = sorted((r["id"] or 0, r["cluster"]) for r in nb.dbscan(few, 0.5, 3).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (4, None), (5, None)]
    with pytest.raises(ValueError):
        nb.within(few, 0.0)


def test_a_vector_is_stored_once(spark):
    """Vectors without near neighbours, which no pivot parts: before, each was copied to every pivot's cell."""
    x = np.random.default_rng(4).normal(size=(900, 16)).astype(np.float32)
    made = nb.packs(nb.distinct_points(frame(spark, x)))
    sizes = made.selectExpr("size(ids) AS n", "length(vectors) AS bytes").collect()
    assert sum(r["n"] for r in sizes) == 900 and sum(r["bytes"] for r in sizes) == x.nbytes and len(sizes) > 1
    d, radius = distances(x), 4.0
    want = {(i, j) for i, j in itertools.combinations(range(900), 2) if d[i, j] <= radius}
    assert {(r["a"], r["b"]) for r in nb.within(nb.distinct_points(frame(spark, x)), radius).collect()} == want
    wide = x[:200].astype(np.float64) + 1e5  # numbers that 4 bytes don't hold, far from zero
    got = nb.within(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "id bigint, vector array<double>"), radius).collect()
    d = distances(wide)
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i, j in itertools.combinations(range(200), 2) if d[i, j] <= radius}
