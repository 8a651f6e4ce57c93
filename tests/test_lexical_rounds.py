"""Rounds of lexical models without stored pairs, against plain loops."""

import collections
import math
import random

import pytest
from corpusloom.operators import lexical_rounds, word_alignment
from pyspark.sql import functions as F

SCHEMA = "seg bigint, source_segment array<string>, target_segment array<string>"


def corpus(spark, n=60, seed=5):
    r = random.Random(seed)
    rows = [(i, [f"s{int(r.expovariate(0.2))}" for _ in range(r.randint(1, 9))], ["the"] * r.randint(0, 3) + [f"t{int(r.expovariate(0.2))}" for _ in range(r.randint(1, 9))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, rounds, weigh, share):
    """(src, trg): prob by loops over all pairs of positions."""
    table = None
    for _ in range(rounds):
        counts = collections.defaultdict(float)
        for _, s, t in rows:
            for j, f in enumerate(t):
                w = weigh(len(s), j, len(t))
                p = [(table[e, f] if table else 1.0) * x for e, x in zip([word_alignment.NULL, *s], w, strict=True)]
                for e, x in zip([word_alignment.NULL, *s], p, strict=True):
                    counts[e, f] += x / sum(p)
        totals, kinds = collections.defaultdict(float), collections.Counter(e for e, _ in counts)
        for (e, _), c in counts.items():
            totals[e] += c
        table = {k: share(c, totals[k[0]], kinds[k[0]]) for k, c in counts.items()}
    return table


def digamma(x):
    return math.log(x + 6) - 1 / (2 * (x + 6)) - 1 / (12 * (x + 6) ** 2) + 1 / (120 * (x + 6) ** 4) - 1 / (252 * (x + 6) ** 6) + 1 / (240 * (x + 6) ** 8) - sum(1 / (x + i) for i in range(6))


def on_diagonal(n, j, m):
    d = [math.exp(-4.0 * abs((i + 1) / n - (j + 1) / m)) for i in range(n)]
    return [0.08, *[0.92 * x / sum(d) for x in d]]


@pytest.mark.parametrize("slice_pairs, pairs", [(16_000_000, 1_000_000), (300, 40), (300, 7)])
def test_tables_equal_plain_loops(spark, monkeypatch, slice_pairs, pairs):
    """With small limits there are many slices, many groups, and words that a group doesn't hold at once."""
    rows, df = corpus(spark)
    monkeypatch.setattr(lexical_rounds, "SLICE_PAIRS", slice_pairs)
    monkeypatch.setattr(lexical_rounds, "PAIRS", pairs)
    monkeypatch.setattr(lexical_rounds._Task, "chunks", lambda self, a, b, f=lexical_rounds._Task.chunks, n=pairs: (f.__globals__.update(PAIRS=n), f(self, a, b))[1])
    even = lambda n, j, m: [1.0] * (n + 1)
    for model, want in (
        (word_alignment.ibm1(df), brute(rows, 4, even, lambda c, total, kinds: c / total)),
        (word_alignment.diagonal(df), brute(rows, 4, on_diagonal, lambda c, total, kinds: math.exp(digamma(c + 0.01) - digamma(total + 0.01 * kinds)))),
    ):
        got = {(r["src"], r["trg"]): r["prob"] for r in model.table().collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_links_and_scores_equal_those_of_the_table(spark):
    _, df = corpus(spark)
    model = word_alignment.ibm1(df)
    table = model.table()
    links = lambda x: {(r["seg"], r["j"], r["i"], round(r["prob"], 9)) for r in x.collect()}
    assert links(model.best()) == links(word_alignment.best_pairs(df, table))
    scores = lambda x: {r["seg"]: round(r["score"], 9) for r in x.collect()}
    assert scores(model.scores()) == scores(word_alignment.average_translation_score(df, table))


def test_no_table_and_no_pair_is_stored(spark, tmp_path):
    """Before, pairs of words lay in the shared folder, more than the segments' words themselves."""
    rows, df = corpus(spark, 400)
    was = lexical_rounds.stash
    stored = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical_rounds, "stash", lambda x, tag: (stored.append((tag, y.count())), y)[1] if (y := was(x, tag)) else y)
        model = word_alignment.ibm1(df)
    words = sum(len(s) + len(t) for _, s, t in rows)
    assert stored and all(n <= words for _, n in stored) and model.of.rows.agg(F.sum(F.size("trgs"))).first()[0] == sum(len(t) for _, _, t in rows)
