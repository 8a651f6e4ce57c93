"""Graphs of translations against all their paths."""

import math
import random
from collections import defaultdict

import pytest
from corpusloom.operators import lattices

SCHEMA = "graph int, prev int, next int, score double, words array<string>"


def drawn(seed):
    r, edges = random.Random(seed), []
    n = r.randint(2, 6)
    for a in range(n):
        for b in range(a + 1, n + 1):
            for _ in range(r.choice([0, 1, 1, 2])):
                edges.append((a, b, round(-3 * r.random(), 3), [r.choice("xyz") for _ in range(r.randint(0, 2))]))
    return edges


def paths(edges):
    ends = {b for _, b, _, _ in edges} | {0}
    ends -= {a for a, _, _, _ in edges}

    def go(state, way):
        if state in ends:
            yield way
        for i, e in enumerate(edges):
            if e[0] == state:
                yield from go(e[1], [*way, i])

    return [w for w in go(0, []) if w]


def test_all_against_all_paths(spark):
    graphs = {k: drawn(k) for k in range(40)}
    df = spark.createDataFrame([(k, *e) for k, es in graphs.items() for e in es], SCHEMA).repartition(3)
    best = {r["graph"]: r for r in lattices.best_paths(df).collect()}
    edges, words = defaultdict(lambda: defaultdict(float)), defaultdict(dict)
    for r in lattices.edge_posteriors(df).collect():
        edges[r["graph"]][r["prev"], r["next"], tuple(r["words"])] += r["posterior"]
    for r in lattices.word_confidences(df).collect():
        words[r["graph"]][r["word"]] = r["confidence"]
    rest = {(r["graph"], r["state"]): r["score"] for r in lattices.rest_scores(df).collect()}
    some = 0
    for k, es in graphs.items():
        ways = paths(es)
        if not ways:
            assert k not in best
            continue
        some += 1
        weight = [math.exp(sum(es[i][2] for i in w)) for w in ways]
        total = sum(weight)
        assert best[k]["score"] == pytest.approx(math.log(max(weight))) and rest[k, 0] == pytest.approx(math.log(max(weight)))
        want, places = defaultdict(float), defaultdict(float)
        for w, p in zip(ways, weight, strict=True):
            said = [x for i in w for x in es[i][3]]
            for i in w:
                want[es[i][0], es[i][1], tuple(es[i][3])] += p / total
            for i, x in enumerate(said):
                places[x, i] += p / total
        assert {e: pytest.approx(p) for e, p in want.items()} == dict(edges[k])
        of = defaultdict(float)
        for (x, _), p in places.items():
            of[x] = max(of[x], p)
        assert {x: pytest.approx(p) for x, p in of.items()} == words[k]
        assert sum(p for (a, _, _), p in edges[k].items() if a == 0) == pytest.approx(1.0)
        ends = {es[w[-1]][1] for w in ways}
        for cut in range(1, min(ends)):  # before any end, every way crosses a cut once
            assert sum(p for (a, b, _), p in edges[k].items() if a <= cut < b) == pytest.approx(1.0)
    assert some > 10


def test_edges(spark):
    rows = [(1, 0, 1, -1.0, None), (1, 1, 2, None, ["x"]), (2, 5, 6, -1.0, ["y"]), (3, 0, 0, 0.0, ["z"]), (4, 0, 1, 0.0, ["a"]), (4, 1, 2, 0.0, ["b"]), (4, 2, 1, 0.0, ["c"]), (None, 0, 1, -2.0, ["n"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["graph"] or 0, r["words"], r["score"]) for r in lattices.best_paths(df).collect()) == [(0, ["n"], -2.0), (1, [], -1.0)]
    assert lattices.word_confidences(df.limit(0)).count() == 0
