"""Marks placed by alignment against all places."""

import random

from corpusloom.operators import placement as pl
from pyspark.sql import functions as F

SCHEMA = "id int, source_words array<string>, target_words array<string>, pairs array<struct<i int, j int>>, marks array<struct<name string, kind string, at int>>"


def brute(pairs, at, m):
    cost = [sum((i < at) != (j < t) for i, j in pairs) for t in range(m + 1)]
    return max(t for t in range(m + 1) if cost[t] == min(cost)) if pairs else m


def placed(spark, rows):
    return {r["id"]: r for r in pl.marked_text(pl.place_marks(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_least_crossings_equal_all_places(spark):
    r, rows, want = random.Random(5), [], {}
    for k in range(400):
        n, m = r.randint(0, 6), r.randint(0, 6)
        pairs = sorted({(r.randrange(n), r.randrange(m)) for _ in range(r.randint(0, 9))}) if n and m else []
        marks = [(f"m{q}", "style", r.randint(0, n)) for q in range(r.randint(0, 3))]
        rows.append((k, ["w"] * n, ["w"] * m, pairs, marks))
        want[k] = sorted((brute(pairs, at, m), at) for _, _, at in marks)
    got = placed(spark, rows)
    assert all(sorted((x["place"], x["at"]) for x in got[k]["marks"]) == w for k, w in want.items())


def test_crossings(spark):
    row = spark.createDataFrame([(0, [], [], [(0, 1), (1, 0), (2, 2)], [])], SCHEMA)
    assert row.select(*[pl.crossings(F.col("pairs"), F.lit(1), F.lit(p)) for p in range(4)]).first() == (1, 2, 1, 2)


def test_texts(spark):
    en, es = "Then he said , come here . Go now".split(), "Entonces dijo , venid acá . Id ya".split()
    pairs = [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7)]
    got = placed(spark, [
        (1, en, es, pairs, [("q1", "paragraph", 4), ("nd", "style", 7), ("nd*", "style", 8)]),
        (2, en, es, pairs, [("p", "paragraph", 6)]),  # before a closing mark: moved past it
        (3, en, es, [], [("p", "paragraph", 2)]),
        (4, None, es, None, None),
        (5, ["a", "b", "c"], ["x", ",", "y", "z"], [(0, 0), (1, 2), (2, 3)], [("p", "paragraph", 1)]),
        (6, "a b c d".split(), ". Y x , w".split(), [(0, 0), (1, 1), (2, 2), (3, 4)], [("p", "paragraph", 2)]),
    ])
    assert got[1]["text"] == "Entonces dijo ,\n\\q1 venid acá . \\nd Id\\nd* ya"
    assert [m["place"] for m in got[2]["marks"]] == [6] and got[2]["text"] == "Entonces dijo , venid acá .\n\\p Id ya"
    assert got[3]["text"].endswith("ya\n\\p") and got[4]["text"] == " ".join(es) and got[4]["marks"] == []
    assert got[5]["marks"][0]["place"] == 2
    assert got[6]["marks"][0]["place"] == 1  # back to the capitalized word after the mark
    assert pl.place_marks(spark.createDataFrame([], SCHEMA)).count() == 0
