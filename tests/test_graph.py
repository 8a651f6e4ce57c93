"""Components and clusters against brute force."""

import math
import random

from corpusloom.operators import graph, neighbourhoods


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(80)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_take_few_jobs(spark):
    """What a round plans and runs stays with the driver; edges that one round turns into stars need no second one."""
    context = spark.sparkContext
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 7)], "u bigint, v bigint")
    context.setJobGroup("components", "")
    got = graph.components(edges)
    jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["node"], r["root"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert jobs <= 12, jobs


def test_dbscan(spark):
    r = random.Random(4)
    points = [(i, [r.gauss(c, 0.3), r.gauss(-c, 0.3), 0.0]) for i in range(120) for c in [r.choice([0, 3, 9])]] + [(500, [50.0, 50.0, 0.0])]
    df = spark.createDataFrame(points, "id bigint, vector array<double>")
    near = {i: [j for j, w in points if math.dist(v, w) <= 0.4] for i, v in points}
    got = {x["id"]: x["cluster"] for x in neighbourhoods.dbscan(df, 0.4, 4).collect()}
    core = {i for i, n in near.items() if len(n) >= 4}
    root = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            for j in near[i]:
                if j in core and root[j] < root[i]:
                    root[i], changed = root[j], True
    at = dict(points)
    for i, v in points:
        if i in core:
            assert got[i] == root[i]
        else:
            best = min(((math.dist(v, at[j]), j) for j in near[i] if j in core), default=None)
            assert got[i] == (root[best[1]] if best else None)
