"""Exact duplicates against grouping by text."""

import hashlib
import random

import pytest
from corpusloom import sizes
from corpusloom.llm.exact_dedup import exact_duplicates, ranked
from pyspark.sql import functions as F


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def got(docs, **more):
    return sorted(tuple(r) for r in exact_duplicates(docs, **more).collect())


def drawn(n, seed=1):
    r = random.Random(seed)
    texts = ["", None, "a", "aaaa", "aaaab", "é" * 9, "abcd" * 8, "abcd" * 8 + "x", "abcd" * 7 + "abce", "abcd" * 16, "abcd" * 4]
    texts += ["".join(r.choice("abé") for _ in range(r.randint(0, 30))) for _ in range(40)]
    return [(i, r.choice(texts)) for i in r.sample(range(1000), n)]


@pytest.mark.parametrize("size", [1, 4, 4096])
def test_equals_grouping_by_text(spark, size):
    rows = drawn(200)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), size=size) == expected(rows)


def test_blocks_of_equal_hashes(spark):
    rows = drawn(120, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs, size=4, hashed=lambda b: F.octet_length(b).cast("bigint")) == expected(rows)


def test_hot_groups_by_either_join(spark, monkeypatch):
    rows = [(i, "copy " * 3 if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = expected(rows)
    monkeypatch.setattr(sizes.join_counted, "__defaults__", ("n", 0))  # no table counts as small
    assert got(docs, size=8) == want


def test_nulls_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "x", 1, "n"), (None, "x", 2, "n"), (3, "x", 3, "m"), (3, "x", 4, "m"), (None, "y", 5, "k"), (7, None, 6, "l"), (8, "", 6, "l")], "doc_id bigint, text string, row int, name string")
    rows = exact_duplicates(docs).collect()
    x = [r for r in rows if r["group_size"] == 4]
    assert len(x) == 4 and sum(r["kept"] for r in x) == 1 and {r["keep_id"] for r in x} == {3} and all(r["doc_id"] == 3 for r in x if r["kept"])
    (y,) = [r for r in rows if r["group_size"] == 1]
    assert y["keep_id"] is None and y["kept"]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in rows if r["group_size"] == 2) == [(7, 8, False), (8, 8, True)]
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_normalize_and_long_texts(spark):
    long = "x" * 3_000_000
    docs = spark.createDataFrame([(1, long + "a"), (2, long + "A"), (3, long + "b"), (4, long + "a")], "doc_id bigint, text string")
    assert [(r[0], r[1], r[2]) for r in got(docs)] == [(1, 4, 2), (2, 2, 1), (3, 3, 1), (4, 4, 2)]
    assert [(r[0], r[1], r[2]) for r in got(docs, normalize=F.lower)] == [(1, 4, 3), (2, 4, 3), (3, 3, 1), (4, 4, 3)]


def test_names_do_not_depend_on_partitions(spark):
    keys = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1000)], "k bigint")
    names = [sorted(tuple(r) for r in ranked(keys.repartition(p), ["k"], "t").collect()) for p in (1, 7)]
    assert names[0] == names[1] and [n for _, n in names[0]] == list(range(1, 1001))
