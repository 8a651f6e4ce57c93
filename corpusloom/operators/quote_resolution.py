"""Depth and direction of quotation marks by a convention, the convention that fits best, and changes of convention.

A text (a chapter, say) is read once, with the marks that are open on a stack. All work on one text is in
one small helper; texts are rows, so Spark deals them out, and conventions are compared by aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quotations import STANDARD

#: Most levels that are open at once. Fixed value.
DEEPEST = 4
Levels = tuple[tuple[str, str], ...]


def levels_of(name: str) -> Levels:
    """(opening, closing) of each level of a standard convention; the levels go round beyond the last."""
    return tuple((p[: len(p) // 2], p[len(p) // 2 :]) for p in STANDARD[name].split())


def _finder(levels: Levels) -> re.Pattern[str]:
    own = sorted({m for pair in levels for m in pair}, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, own)))


def resolve(text: str, levels: Levels) -> tuple[list[tuple[int, str, int, str]], int]:
    """(marks, issues): each mark's place, text, depth from 1 and direction; issues are marks that fit nowhere, and such
    as are never closed.

    A single mark between letters is an apostrophe, and so is a closing one after a letter with nothing of
    its kind open. At a line's start, marks of what is open go on with it: they are continuers.
    """
    out, stack, issues, line_start = [], [], 0, 0
    for m in _finder(levels).finditer(text):
        mark, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        line_start = text.rfind("\n", 0, m.start()) + 1
        inside = before.isalnum() and after.isalnum()
        if inside and mark in "'’":
            continue
        depth = len(stack)
        opening = levels[depth][0] if depth < min(len(levels), DEEPEST) else None
        closing = levels[depth - 1][1] if depth else None
        continues = depth and line_start > stack[-1][0] and not re.sub(r"[\s\W_]", "", text[line_start : m.start()]) and mark in {levels[d][0] for d in range(depth)}
        can_open = mark == opening and bool(after) and not after.isspace() and not before.isalnum()
        can_close = mark == closing and bool(before) and not before.isspace()
        if continues and not (can_close and not can_open):
            at = next(d for d in range(depth) if levels[d][0] == mark)
            out.append((m.start(), mark, at + 1, "continuer"))
        elif can_close and not (can_open and mark != closing):
            stack.pop()
            out.append((m.start(), mark, depth, "closing"))
        elif can_open:
            stack.append((m.start(), mark))
            out.append((m.start(), mark, depth + 1, "opening"))
        elif mark in "'’" and before.isalnum():
            continue
        else:
            issues += 1
    return out, issues + len(stack)


def resolved(texts: DataFrame, key: list[str], convention: str, text: str = "text") -> DataFrame:
    """(key, at, mark, depth, direction) of all marks of each text under a standard convention."""
    levels = levels_of(convention)

    @F.pandas_udf("array<struct<at:int,mark:string,depth:int,direction:string>>")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [] if t is None else [{"at": a, "mark": m, "depth": d, "direction": x} for a, m, d, x in resolve(t, levels)[0]])

    return texts.select(*key, F.explode(apply(F.col(text))).alias("x")).select(*key, "x.*")


def convention_scores(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, name, n_marks, n_resolved, n_levels, score) of each standard convention over all texts of a group.

    score is the share of all quotation marks that the convention resolves, less its issues' share: a
    convention that doesn't know a text's marks leaves them.
    """
    names = list(STANDARD)
    whole = re.compile("<<|>>|[\"“”„‟'‘’‚‛«»‹›<>]")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {n: levels_of(n) for n in names}
        for frame in frames:
            rows = []
            for *group, value in frame.itertuples(index=False):
                value = value or ""
                n = sum(1 for m in whole.finditer(value) if not (value[m.start() - 1 : m.start()].isalnum() and value[m.end() : m.end() + 1].isalnum() and m[0] in "'’"))
                if not n:
                    continue
                for name, levels in known.items():
                    marks, issues = resolve(value, levels)
                    rows.append((*group, name, n, len(marks), issues, max((d for _, _, d, _ in marks), default=0)))
            yield pd.DataFrame(rows, columns=[*by, "name", "n", "ok", "issues", "deep"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in by)
    each = texts.select(*by, text).mapInPandas(run, f"{kinds}, name string, n bigint, ok bigint, issues bigint, deep bigint")
    sums = each.groupBy(*by, "name").agg(F.sum("n").alias("n_marks"), F.sum("ok").alias("n_resolved"), F.sum("issues").alias("n_issues"), F.max("deep").alias("n_levels"))
    score = (F.col("n_resolved") - F.col("n_issues")) / F.col("n_marks")
    return sums.select(*by, "name", "n_marks", "n_resolved", "n_levels", F.greatest(score, F.lit(0.0)).alias("score"))


def detect(texts: DataFrame, by: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """(by, name, score): each group's best convention, if it scores enough; of equals the one with more levels in use,
    then the first in the list of standard ones."""
    scores = convention_scores(texts, by, text)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("n_levels"), F.array_position(F.array(*[F.lit(n) for n in STANDARD]), F.col("name"))))
    return scores.withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("score") >= least)).select(*by, "name", "score")


def changed(text: Column, source: str, target: str) -> Column:
    """Text with the marks of one convention put in another's; what the first doesn't resolve stays."""
    old, new = levels_of(source), levels_of(target)

    def put(value: str | None) -> str | None:
        if value is None:
            return None
        out, end = [], 0
        for at, mark, depth, direction in resolve(value, old)[0]:
            pair = new[(depth - 1) % len(new)]
            out += [value[end:at], pair[direction == "closing"]]
            end = at + len(mark)
        return "".join(out) + value[end:]

    @F.pandas_udf("string")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(put)

    return apply(text)
