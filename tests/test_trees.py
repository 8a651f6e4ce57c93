"""Trees of objects against plain versions that join one pair at a time."""

import itertools
import random

from corpusloom.operators import trees


def frames(spark, matrix, numbers=None):
    n = numbers or range(len(matrix))
    rows = [(n[i], n[j], float(matrix[i][j])) for i, j in itertools.combinations(range(len(matrix)), 2)]
    return spark.createDataFrame([(i,) for i in n], "id bigint"), spark.createDataFrame(rows, "a bigint, b bigint, dist double")


def plain_upgma(matrix):
    """Sets of members and heights, joined pair by pair."""
    parts, out = [frozenset([i]) for i in range(len(matrix))], {}
    mean = lambda p, q: sum(matrix[i][j] for i in p for j in q) / len(p) / len(q)
    while len(parts) > 1:
        p, q = min(itertools.combinations(parts, 2), key=lambda x: mean(*x))
        out[p | q] = mean(p, q) / 2
        parts = [x for x in parts if x not in (p, q)] + [p | q]
    return out


def members(rows):
    """The joins of a tree as sets of members with heights."""
    of, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["size"], r["height"])):
        left, right = of.get(r["left"], frozenset([r["left"]])), of.get(r["right"], frozenset([r["right"]]))
        of[r["node"]] = left | right
        assert len(left | right) == r["size"]
        out[left | right] = r["height"]
    return out


def test_average_linkage_example(spark):
    matrix = [[0, 2, 4, 6, 6, 8], [2, 0, 4, 6, 6, 8], [4, 4, 0, 6, 6, 8], [6, 6, 6, 0, 4, 8], [6, 6, 6, 4, 0, 8], [8, 8, 8, 8, 8, 0]]
    objects, distances = frames(spark, matrix)
    tree = trees.average_linkage(objects, distances)
    assert members(tree.collect()) == {frozenset([0, 1]): 1.0, frozenset([3, 4]): 2.0, frozenset([0, 1, 2]): 2.0, frozenset(range(5)): 3.0, frozenset(range(6)): 4.0}
    got = {r["id"]: r["cluster"] for r in trees.flat_clusters(objects, tree, 2.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_average_linkage_equals_one_pair_at_a_time(spark):
    r = random.Random(4)
    points = [(r.random(), r.random(), r.random()) for _ in range(22)]
    matrix = [[sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5 for q in points] for p in points]
    got, want = members(trees.average_linkage(*frames(spark, matrix)).collect()), plain_upgma(matrix)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_neighbour_joining_example(spark):
    matrix = [[0, 1, 2, 3, 3], [1, 0, 2, 3, 3], [2, 2, 0, 3, 3], [3, 3, 3, 0, 1], [3, 3, 3, 1, 0]]
    edges = {(r["node"], r["parent"]): r["length"] for r in trees.neighbour_joining(*frames(spark, matrix)).collect()}
    ends = {}
    for (a, b), n in edges.items():
        ends.setdefault(a, {})[b] = n
        ends.setdefault(b, {})[a] = n

    def far(a, b, before=None):
        return 0.0 if a == b else min((n + far(c, b, a) for c, n in ends[a].items() if c != before), default=float("inf"))

    # The distances are those of a tree, so the edges give them back: the three inner ones are the example's.
    assert all(abs(far(i, j) - matrix[i][j]) < 1e-9 for i, j in itertools.combinations(range(5), 2))
    assert sorted(edges.values()) == [0.5, 0.5, 0.5, 0.5, 0.5, 1.0, 1.5]


def test_edges(spark):
    objects, distances = frames(spark, [[0]])
    assert trees.average_linkage(objects, distances.limit(0)).count() == 0 and trees.neighbour_joining(objects, distances.limit(0)).count() == 0
    two = frames(spark, [[0, 3], [3, 0]])
    assert [tuple(r) for r in trees.neighbour_joining(*two).collect()] == [(0, 1, 3.0)]
    assert [tuple(r) for r in trees.average_linkage(*two).collect()] == [(0, 0, 1, 1.5, 2)]
    # All distances equal: ties go by numbers.
    tied = trees.average_linkage(*frames(spark, [[0 if i == j else 1 for j in range(5)] for i in range(5)]))
    assert tied.count() == 4 and {r["height"] for r in tied.collect()} == {0.5}
