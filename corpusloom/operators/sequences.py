"""Alignment of two sequences by dynamic programming, row by row over Arrow batches; distances and word pairs from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Which ends may stay outside: of a global alignment none, of a half-local one what follows, of a
#: semi-global one either end of either sequence without a cost, of a local one any at a score of 0.
MODES = ("global", "semi-global", "half-local", "local")


def same_or_not(match: float = 1.0, other: float = -1.0) -> Callable[[str, str], float]:
    return lambda a, b: match if a == b else other


def align(a: Sequence[str], b: Sequence[str], score: Callable[[str, str], float], gap: float = -1.0, mode: str = "global") -> tuple[float, list[tuple[int, int]]]:
    """The best score and its columns (i, j), -1 for a gap; of equal ways a pair goes before a gap in b, then one in a."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    free_start, local = mode in ("semi-global", "local"), mode == "local"
    n, m = len(a), len(b)
    table = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        table[i][0] = 0.0 if free_start else i * gap
    for j in range(1, m + 1):
        table[0][j] = 0.0 if free_start else j * gap
    for i in range(1, n + 1):
        above, row, x = table[i - 1], table[i], a[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j - 1] + score(x, b[j - 1]), above[j] + gap, row[j - 1] + gap, 0.0 if local else float("-inf"))
    if mode == "global":
        i, j = n, m
    elif mode == "semi-global":
        i, j = max([(n, j) for j in range(m + 1)] + [(i, m) for i in range(n + 1)], key=lambda c: table[c[0]][c[1]])
    else:
        i, j = max(((i, j) for i in range(n + 1) for j in range(m + 1)), key=lambda c: table[c[0]][c[1]])
    best, out = table[i][j], []
    while i or j:
        if local and table[i][j] == 0.0 or free_start and not (i and j):
            break
        if i and j and table[i][j] == table[i - 1][j - 1] + score(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i][j] == table[i - 1][j] + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return best, out[::-1]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two sequences; a row of the table is kept at a time."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def prefix_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """The least distance of a from a prefix of b: what it takes for b to go on from a."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i - 1] + (x != y), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def _mapped(rows: DataFrame, one: str, two: str, made: dict[str, str], f) -> DataFrame:
    kept = [c for c in rows.columns if c not in made]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t}" for n, t in made.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [f(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(frame[one], frame[two], strict=True)]
            yield frame[kept].assign(**{n: [g[k] for g in got] for k, n in enumerate(made)})

    return rows.mapInPandas(run, schema)


def aligned(rows: DataFrame, one: str, two: str, mode: str = "global", match: float = 1.0, other: float = -1.0, gap: float = -1.0) -> DataFrame:
    """rows with score and columns of the best alignment of two array columns; null arrays are empty."""

    def f(a, b):
        score, columns = align(a, b, same_or_not(match, other), gap, mode)
        return score, [{"i": i, "j": j} for i, j in columns]

    return _mapped(rows, one, two, {"score": "double", "columns": "array<struct<i:int,j:int>>"}, f)


def distances(rows: DataFrame, one: str, two: str) -> DataFrame:
    """rows with distance (of words) and prefix_distance (of one from a prefix of two)."""
    return _mapped(rows, one, two, {"distance": "bigint", "prefix_distance": "bigint"}, lambda a, b: (distance(a, b), prefix_distance(a, b)))


def _likeness(a: str, b: str) -> float:
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def edit_pairs(rows: DataFrame, one: str, two: str, least: float | None = None) -> DataFrame:
    """rows with pairs (i, j) of words that an alignment of least edits puts together: equal ones, or, if least is
    given, also such as are that alike (1 less their distance over the greater length)."""

    def f(a, b):
        near = {}

        def score(x, y):
            if x == y or least is None:
                return 1.0 if x == y else -1.0
            if (x, y) not in near:
                near[x, y] = _likeness(x, y)
            return near[x, y] if near[x, y] >= least else -1.0

        return ([{"i": i, "j": j} for i, j in align(a, b, score, -0.5)[1] if i >= 0 and j >= 0 and score(a[i], b[j]) > 0],)

    return _mapped(rows, one, two, {"pairs": "array<struct<i:int,j:int>>"}, f)
