"""The hidden Markov aligner and the diagonal one against brute force and known answers."""

import itertools
import math
import random

import numpy as np
from corpusloom.operators import hmm, word_alignment
from pyspark.sql import functions as F

SPANISH = [("es una casa", "is a house"), ("una casa roja", "a red house"), ("es roja", "is red"), ("la casa", "the house"), ("es la casa", "is the house"), ("una flor", "a flower"), ("la flor roja", "the red flower")]


def parallel(spark):
    rows = [(i, s.split(), t.split()) for i, (s, t) in enumerate(SPANISH * 3)] + [(90, [], ["x"]), (91, ["y"], [])]
    return spark.createDataFrame(rows, "seg bigint, source_segment array<string>, target_segment array<string>")


def test_forward_backward_and_viterbi_equal_all_paths():
    r = np.random.default_rng(3)
    for _ in range(20):
        n, m = int(r.integers(1, 4)), int(r.integers(1, 4))
        matrix, null = r.random((n, m)), r.random(m)
        first, move = hmm.transitions(n, {d: float(x) for d, x in zip(range(-3, 5), r.random(8))}, 0.2)
        assert np.allclose(first.sum(), 1) and np.allclose(move.sum(axis=1), 1)
        emit = hmm._emissions(matrix, null)
        weight = lambda p: first[p[0]] * emit[0, p[0]] * math.prod(move[a, b] * emit[j, b] for j, (a, b) in enumerate(zip(p, p[1:]), 1))  # noqa: B023,E731
        paths = list(itertools.product(range(2 * n), repeat=m))
        total = sum(map(weight, paths))
        state, used = hmm.forward_backward(matrix, null, first, move)
        for j in range(m):
            for x in range(2 * n):
                assert np.isclose(state[j, x], sum(weight(p) for p in paths if p[j] == x) / total)
        for a, b in itertools.product(range(2 * n), repeat=2):
            assert np.isclose(used[a, b], sum(weight(p) * sum(q == (a, b) for q in zip(p, p[1:])) for p in paths) / total)
        best = max(paths, key=weight)
        assert hmm.viterbi(matrix, null, first, move) == [x if x < n else -1 for x in best]


def test_hmm_learns_the_words(spark):
    df = parallel(spark)
    table, jumps = hmm.train_hmm(df)
    prob = {(r["src"], r["trg"]): r["prob"] for r in table.collect()}
    assert prob["casa", "house"] > 0.6 and prob["es", "is"] > 0.6 and abs(sum(p for (s, _), p in prob.items() if s == "casa") - 1) < 1e-9
    assert abs(sum(jumps.values()) - 1) < 1e-9 and max(jumps, key=jumps.get) == 1
    got = {r["seg"]: [tuple(p) for p in r["pairs"]] for r in hmm.align_hmm(df, table, jumps).collect()}
    assert got[0] == [(0, 0), (1, 1), (2, 2)] and (0, 0) in got[1] and 90 not in got and 91 not in got


def test_diagonal_with_and_without_a_prior(spark):
    r = random.Random(1)
    xs = [r.random() * 10 + 1e-3 for _ in range(50)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", word_alignment.digamma(F.col("x")).alias("d")).collect()
    assert all(abs((math.lgamma(g["x"] + 1e-5) - math.lgamma(g["x"] - 1e-5)) / 2e-5 - g["d"]) < 1e-3 * max(1, abs(g["d"])) for g in got)
    df = parallel(spark).where("seg < 90")
    for alpha in (None, 0.01):
        prob = {(x["src"], x["trg"]): x["prob"] for x in word_alignment.train_diagonal(df, alpha=alpha).collect()}
        assert prob["es", "is"] > 0.8 and prob["casa", "house"] > 0.8


def test_long_segments_begin_evenly():
    first, move = hmm.transitions(1500, None, 0.2)
    assert np.allclose(first[:1500], 0.8 / 1500) and np.allclose(move[0, :1500], 0.8 / 1500) and np.allclose(move[1499, 0], 0.8 / 1500)
    first, move = hmm.transitions(3, {1: 0.5, 0: 0.3, -1: 0.1, 2: 0.1}, 0.0)
    assert np.allclose(move[0, :3], np.array([0.3, 0.5, 0.1]) / 0.9) and np.allclose(first[:3], np.array([0.5, 0.1, 0.0]) / 0.6)
