"""Vector codes against a plain version with Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from corpusloom.llm import vector_codes as vc


def plain(rows, parts=16, entries=64, rounds=2):
    """Of (vec_id, vector, label): every distance in Python's integers."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(Fraction(x) * 256) for x in v] for _, v, _ in ok]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    order = sorted(range(len(ok)), key=lambda i: ok[i][0])
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(part, book):
        d = [far(part, e) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else b for e, b in enumerate(books[p])]
    got = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in g) for g in got]
    sums = {}
    for (_, _, label), e in zip(ok, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c, _ in g), e, sums[label], sha) for (i, _, label), g, e in zip(ok, got, errors, strict=True))


def got(df, **more):
    return sorted(tuple(r) for r in vc.compress(df, **more).collect())


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("scale", [1.0, 0.01, 3e4])
def test_equals_plain_version(spark, scale):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=32) * scale], int(r.integers(3)) or None) for i in r.permutation(150)]
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] + [0.0] * 31, 1), (204, rows[0][1], 2)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 3)] * 16, 1) for i in range(9)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert [r[1] for r in got(spark.createDataFrame(rows, SCHEMA))][:3] == ["00" * 16, "01" * 16, "02" * 16]


def test_huge_components(spark):
    rows = [(i, [x * (i + 1) for x in (3e18, -1e9, 5e-3, 7e12)] * 4, 1) for i in range(6)]
    assert vc.integers(np.array([[1e308, -0.001]])).tolist() == [[int(1e308) * 256, -1]]
    want = plain(rows, 16, 2)
    assert [r[1] for r in got(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), entries=2)] == [r[1] for r in want]
    assert {r[2] if r[2] < 1 << 63 else None for r in want} == {r[2] for r in got(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), entries=2)}


def test_screening_keeps_the_nearest_and_little_else():
    r = np.random.default_rng(5)
    for top in (3, 200, 1 << 14, 1 << 27):
        x, c = r.integers(-top, top, (400, 4)), r.integers(-top, top, (64, 4))
        d = np.square(x[:, None] - c[None]).sum(2)
        may = vc.candidates(x, c)
        assert may[d == d.min(1)[:, None]].all() and may.mean() < 0.2
        best, far = vc.nearest(x, c)
        assert (best == d.argmin(1)).all() and (far == d.min(1)).all()
    close = np.full((5, 4), (1 << 27) - 1), np.array([[(1 << 27)] * 4, [(1 << 27) - 2] * 4, [(1 << 27) - 1] * 3 + [(1 << 27) - 2]])
    assert vc.nearest(*close)[0].tolist() == [2] * 5


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    rows = [(None, [1.0] * 16, None), (1, [2.0] * 16, None), (1, [2.0] * 16, None), (2, [], 1), (3, [1.0] * 15, 1), (4, [1.0] * 32, 1)]
    out = vc.compress(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", code string, n int")).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["label_error"]) for r in out) == [(0, "02" * 16, 0), (1, "00" * 16, 0), (1, "00" * 16, 0)]
