"""Word alignment: IBM-1 and a diagonal prior by expectation maximization, best pairs, symmetrization."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash
from .lexical_rounds import NULL, Model, diagonal_weights, plain_share, trained, variational_share


def word_pairs(parallel: DataFrame, source: str = "source_segment", target: str = "target_segment") -> DataFrame:
    """(seg, j, trg, i, src): each target word with each source word of its segment and the null word (i = -1)."""
    rows = parallel.select("seg", F.col(source).alias("s"), F.posexplode(target).alias("j", "trg"))
    return rows.select("seg", "j", "trg", F.size("s").alias("n_source"), F.posexplode(F.concat(F.array(F.lit(NULL)), "s")).alias("at", "src")).withColumn("i", F.col("at") - 1).drop("at")


def ibm1(parallel: DataFrame, iterations: int = 4) -> Model:
    """A model after some rounds, from even probabilities; see lexical_rounds for what it gives without its table."""
    return trained(parallel, iterations)


def train_ibm1(parallel: DataFrame, iterations: int = 4) -> DataFrame:
    """(src, trg, prob) after some rounds, from even probabilities, at rest."""
    if iterations < 1:
        return parallel.sparkSession.createDataFrame([], "src string, trg string, prob double")
    return stash(ibm1(parallel, iterations).table(), "ibm1")


def diagonal_prior(i: Column, j: Column, n_source: Column, n_target: Column, tension: float = 4.0) -> Column:
    """The unscaled preference of pairs near the diagonal."""
    return F.exp(-tension * F.abs((i + 1) / n_source - (j + 1) / n_target))


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for positive numbers: shifted up by 6, then its series."""
    y = x + 6
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


def diagonal(parallel: DataFrame, iterations: int = 4, null_share: float = 0.08, tension: float = 4.0, alpha: float | None = 0.01) -> Model:
    """IBM-1's rounds with positions weighed by their distance from the diagonal.

    alpha is the Dirichlet prior of variational Bayes, by which rare pairs lose (probabilities of a source
    word then add up to less than 1); without it, counts are divided by their sum.
    """
    return trained(parallel, iterations, diagonal_weights(null_share, tension), plain_share if alpha is None else variational_share(alpha))


def train_diagonal(parallel: DataFrame, iterations: int = 4, null_share: float = 0.08, tension: float = 4.0, alpha: float | None = 0.01) -> DataFrame:
    """(src, trg, prob) of diagonal(), at rest."""
    return stash(diagonal(parallel, iterations, null_share, tension, alpha).table(), "diagonal")


def train_ibm2(parallel: DataFrame, iterations: int = 4, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, trg, prob) and (i, j, n_source, n_target, prob), positions having probabilities of their own.

    first is a table to begin with, IBM-1's if it isn't given; positions begin evenly. Each round is as in
    IBM-1, with one more aggregation for the positions.
    """
    sizes = parallel.select("seg", F.size("target_segment").alias("n_target"))
    pairs = stash(word_pairs(parallel).join(sizes, "seg"), "ibm2-pairs")
    table = train_ibm1(parallel) if first is None else first
    place, at = None, ["i", "j", "n_source", "n_target"]
    for _ in range(iterations):
        rows = pairs.join(table.withColumnRenamed("prob", "t"), ["src", "trg"])
        rows = rows.withColumn("a", 1 / (F.col("n_source") + 1)) if place is None else rows.join(place.withColumnRenamed("prob", "a"), at)
        rows = rows.withColumn("p", F.col("t") * F.col("a"))
        sums = rows.groupBy("seg", "j").agg(F.sum("p").alias("z"))
        shares = stash(rows.join(sums.where("z > 0"), ["seg", "j"]).select("src", "trg", *at, (F.col("p") / F.col("z")).alias("c")), "ibm2-shares")
        words = shares.groupBy("src", "trg").agg(F.sum("c").alias("c"))
        table = stash(words.join(words.groupBy("src").agg(F.sum("c").alias("total")), "src").select("src", "trg", (F.col("c") / F.col("total")).alias("prob")), "ibm2")
        spots = shares.groupBy(*at).agg(F.sum("c").alias("c"))
        place = stash(spots.join(spots.groupBy(*at[1:]).agg(F.sum("c").alias("total")), at[1:]).select(*at, (F.col("c") / F.col("total")).alias("prob")), "ibm2-places")
    return table, place


def exclusive_links(scores: Column) -> Column:
    """Pairs (i, j) of scores (array of structs i, j, score), each position in one pair at most.

    The best pair is taken first; of equals the one nearer to the diagonal, then the lesser positions.
    """
    order = F.array_sort(F.transform(scores, lambda x: F.struct((-x["score"]).alias("cost"), F.abs(x["i"] - x["j"]).alias("far"), x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")

    def step(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j")))))

    return F.array_sort(F.aggregate(order, none, step))


def _exclusive(scores: list[float], n_target: int) -> list[tuple[int, int]]:
    i, j = np.divmod(np.arange(len(scores)), max(n_target, 1))
    order = np.lexsort((np.abs(i - j), -np.asarray(scores, dtype=float)))  # stable: of equals the lesser positions
    most, rows, cols, out = min(len(scores) // max(n_target, 1), n_target), set(), set(), []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if len(out) == most:
            break
        if x not in rows and y not in cols:
            rows.add(x)
            cols.add(y)
            out.append((x, y))
    return sorted(out)


def exclusive_links_of_all(rows: DataFrame, n_target: str, scores: str) -> DataFrame:
    """rows with pairs in place of scores: exclusive_links where each pair of positions has a score.

    scores are doubles by source position, then target position. Positions in use are looked up in sets,
    so a segment takes the time of sorting its scores. Batches are small: scores grow with both lengths.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [[{"i": i, "j": j} for i, j in _exclusive(s, n)] for s, n in zip(f[scores], f[n_target], strict=True)]
            yield f.drop(columns=[scores]).assign(pairs=made)

    kept = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema if x.name != scores)
    return rows.mapInPandas(run, f"{kept}, pairs array<struct<i: int, j: int>>")


def phrase_pairs(aligned: DataFrame, longest: int = 7) -> DataFrame:
    """(seg, src, trg) of aligned (seg, source_segment, target_segment, pairs): phrases that pairs never leave.

    A source phrase goes with the target words between its first and last partner. It is left out if one of
    those words has a partner outside it. Phrases aren't widened by words without partners.
    """
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("source_segment") - 1),
            lambda a: F.transform(F.sequence(a, F.least(a + longest, F.size("source_segment")) - 1), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )
    rows = aligned.where((F.size("source_segment") > 0) & (F.size("pairs") > 0)).select("*", F.explode(spans).alias("s"))
    inner = F.filter("pairs", lambda p: p["i"].between(F.col("s.a"), F.col("s.b")))
    rows = rows.withColumn("js", F.transform(inner, lambda p: p["j"])).where(F.size("js") > 0)
    rows = rows.withColumn("c", F.array_min("js")).withColumn("d", F.array_max("js")).where(F.col("d") - F.col("c") < longest)
    leaves = F.exists("pairs", lambda p: p["j"].between(F.col("c"), F.col("d")) & ~p["i"].between(F.col("s.a"), F.col("s.b")))
    cut = lambda side, a, b: F.array_join(F.slice(side, a + 1, b - a + 1), " ")
    return rows.where(~leaves).select("seg", cut("source_segment", F.col("s.a"), F.col("s.b")).alias("src"), cut("target_segment", F.col("c"), F.col("d")).alias("trg"))


def phrase_table(aligned: DataFrame, longest: int = 7) -> DataFrame:
    """(src, trg, n, prob, inverse): phrases with their shares among the source's and the target's pairs."""
    n = phrase_pairs(aligned, longest).groupBy("src", "trg").agg(F.count("*").alias("n"))
    of_source, of_target = n.groupBy("src").agg(F.sum("n").alias("s")), n.groupBy("trg").agg(F.sum("n").alias("t"))
    return n.join(of_source, "src").join(of_target, "trg").select("src", "trg", "n", (F.col("n") / F.col("s")).alias("prob"), (F.col("n") / F.col("t")).alias("inverse"))


def best_pairs(parallel: DataFrame, table: DataFrame) -> DataFrame:
    """(seg, j, i, prob): each target word's likeliest source word; of equals the first; null words are left out.

    Probabilities are equal up to 12 digits: sums in another order differ in the last ones.
    """
    rows = word_pairs(parallel).join(table, ["src", "trg"])
    best = rows.groupBy("seg", "j").agg(F.max_by(F.struct("i", "prob"), F.struct(F.round("prob", 12), -F.col("i"))).alias("b"))
    return best.select("seg", "j", "b.i", "b.prob").where("i >= 0")


def average_translation_score(parallel: DataFrame, table: DataFrame) -> DataFrame:
    """(seg, score): the mean of the best probabilities of target words, null words too."""
    rows = word_pairs(parallel).join(table, ["src", "trg"], "left")
    return rows.groupBy("seg", "j").agg(F.coalesce(F.max("prob"), F.lit(0.0)).alias("p")).groupBy("seg").agg(F.avg("p").alias("score"))


def lexicon(table: DataFrame, threshold: float = 0.0, beam: float = 0.02) -> DataFrame:
    """(src, trg, prob) above a probability and within a beam of the source word's best."""
    table = stash(table.where((F.col("src") != NULL) & (F.col("prob") > threshold)), "lexicon")  # a best one stays if any of its word's does
    best = table.groupBy("src").agg(F.max("prob").alias("best"))
    return table.join(best, "src").where(F.col("prob") >= beam * F.col("best")).select("src", "trg", "prob")


def symmetrized_table(direct: DataFrame, inverse: DataFrame) -> DataFrame:
    """(src, trg, prob): the greater of both directions; inverse has its src in the target language."""
    other = inverse.select(F.col("trg").alias("src"), F.col("src").alias("trg"), F.col("prob").alias("q"))
    return direct.join(other, ["src", "trg"], "full").select("src", "trg", F.greatest(F.coalesce("prob", F.lit(0.0)), F.coalesce("q", F.lit(0.0))).alias("prob"))


def union(a: Column, b: Column) -> Column:
    """Pairs (arrays of structs i, j) of either direction."""
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def _neighbours(diagonal: bool) -> list[tuple[int, int]]:
    near = [(-1, 0), (0, -1), (1, 0), (0, 1)]
    return near + [(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else near


def symmetrize(a: set[tuple[int, int]], b: set[tuple[int, int]], heuristic: str) -> set[tuple[int, int]]:
    """Pairs of two directions put together.

    union, intersection; och: the intersection grows by pairs of the union whose row and column are free, or
    which have a pair beside them; priority: the first direction grows by pairs of the second whose row and
    column are free, or which have a pair beside them along one of them only; grow, grow-diag: by neighbours of pairs with a free row or
    column; -final: then by all pairs with a free row or column; -final-and: by those with both free.
    """
    both, either = a & b, a | b
    if heuristic == "union":
        return either
    if heuristic == "intersection":
        return both
    out = set(both)
    rows, cols = {i for i, _ in out}, {j for _, j in out}

    def add(p: tuple[int, int]) -> None:
        out.add(p)
        rows.add(p[0])
        cols.add(p[1])

    changed = True
    if heuristic == "priority":
        out, rows, cols = set(a), {i for i, _ in a}, {j for _, j in a}
    if heuristic in ("och", "priority"):
        while changed:
            changed = False
            for i, j in sorted(either - out):
                across = (i, j - 1) in out or (i, j + 1) in out
                along = (i - 1, j) in out or (i + 1, j) in out
                beside = across or along if heuristic == "och" else across != along
                if i not in rows and j not in cols or beside:
                    add((i, j))
                    changed = True
        return out
    near = _neighbours("diag" in heuristic)
    while changed:
        changed = False
        for i, j in sorted(out):
            for x, y in near:
                p = (i + x, j + y)
                if p in either and p not in out and (p[0] not in rows or p[1] not in cols):
                    add(p)
                    changed = True
    if heuristic.endswith("final"):
        for p in [*sorted(a), *sorted(b)]:
            if p not in out and (p[0] not in rows or p[1] not in cols):
                add(p)
    elif heuristic.endswith("final-and"):
        for p in [*sorted(a), *sorted(b)]:
            if p[0] not in rows and p[1] not in cols:
                add(p)
    return out


def symmetrize_rows(rows: DataFrame, heuristic: str = "grow-diag-final-and") -> DataFrame:
    """rows (seg, direct, inverse: arrays of structs i, j) with pairs, put together segment by segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [symmetrize({(p["i"], p["j"]) for p in d}, {(p["i"], p["j"]) for p in v}, heuristic) for d, v in zip(f["direct"], f["inverse"], strict=True)]
            yield pd.DataFrame({"seg": f["seg"], "pairs": [[{"i": i, "j": j} for i, j in sorted(m)] for m in made]})

    kind = rows.schema["seg"].dataType.simpleString()
    return rows.select("seg", "direct", "inverse").mapInPandas(run, f"seg {kind}, pairs array<struct<i: int, j: int>>")


def transpose(pairs: Column) -> Column:
    """Pairs of the other direction."""
    return F.array_sort(F.transform(pairs, lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))))


def resize(pairs: Column, n_source: Column, n_target: Column) -> Column:
    """Pairs within the first n_source and n_target words."""
    return F.filter(pairs, lambda p: (p["i"] < n_source) & (p["j"] < n_target))


def row_aligned(pairs: Column, i: Column) -> Column:
    return F.exists(pairs, lambda p: p["i"] == i)


def column_aligned(pairs: Column, j: Column) -> Column:
    return F.exists(pairs, lambda p: p["j"] == j)


def neighbour_aligned(pairs: Column, i: Column, j: Column, way: str) -> Column:
    """Whether a pair lies beside (i, j): across (same i), along (same j) or diagonal."""
    far_i, far_j = (lambda p: F.abs(p["i"] - i)), (lambda p: F.abs(p["j"] - j))
    sides = {"across": (0, 1), "along": (1, 0), "diagonal": (1, 1)}[way]
    return F.exists(pairs, lambda p: (far_i(p) == sides[0]) & (far_j(p) == sides[1]))


def with_nulls(pairs: Column, n_source: Column, n_target: Column) -> Column:
    """Pairs, and for each word without one a pair with -1; target words without one first."""
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    targets = F.transform(F.array_except(numbers(n_target), F.transform(pairs, lambda p: p["j"].cast("int"))), lambda j: pair(F.lit(-1), j))
    sources = F.transform(F.array_except(numbers(n_source), F.transform(pairs, lambda p: p["i"].cast("int"))), lambda i: pair(i, F.lit(-1)))
    return F.concat(targets, F.array_sort(F.concat(F.transform(pairs, lambda p: pair(p["i"], p["j"])), sources)))


def merge_known(estimated: Column, known: Column) -> Column:
    """Known pairs, and those estimated whose words have no known pair."""
    free = F.filter(estimated, lambda e: ~F.exists(known, lambda k: (k["i"] == e["i"]) | (k["j"] == e["j"])))
    return F.array_sort(F.concat(known, free))


def translations(table: DataFrame, threshold: float = 0.0, most: int | None = None) -> DataFrame:
    """(src, trg, prob, rank): each source word's translations over a threshold, likeliest first."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("prob"), "trg"))
    rows = table.where((F.col("prob") > threshold) & (F.col("src") != NULL)).withColumn("rank", rank)
    return rows if most is None else rows.where(F.col("rank") <= most)


def to_giza(number: Column, source: Column, target: Column, pairs: Column) -> Column:
    """Three lines of one segment: a heading, the target words, the source words with their targets' numbers from 1."""
    numbers = lambda i: F.array_join(F.transform(F.array_sort(F.transform(F.filter(pairs, lambda p: p["i"] == i), lambda p: p["j"])), lambda j: (j + 1).cast("string")), " ")
    listed = lambda w, ns: F.concat(w, F.lit(" ({ "), F.when(ns == "", "").otherwise(F.concat(ns, F.lit(" "))), F.lit("})"))
    free = F.array_except(F.sequence(F.lit(1), F.greatest(F.size(target), F.lit(1))), F.transform(pairs, lambda p: (p["j"] + 1).cast("int")))
    null = listed(F.lit("NULL"), F.when(F.size(target) > 0, F.array_join(F.transform(free, lambda j: j.cast("string")), " ")).otherwise(""))
    heading = F.concat(F.lit("# Sentence pair ("), number.cast("string"), F.lit(") source length "), F.size(source).cast("string"), F.lit(" target length "), F.size(target).cast("string"), F.lit(" alignment score : 0"))
    return F.concat_ws("\n", heading, F.array_join(target, " "), F.array_join(F.concat(F.array(null), F.transform(source, lambda w, i: listed(w, numbers(i)))), " "))


def _number(x: Column) -> Column:
    """A number with up to eight decimals and no zeros at its end."""
    return F.regexp_replace(F.format_string("%.8f", x.cast("double")), r"\.?0+$", "")


def to_pharaoh(pairs: Column) -> Column:
    """Pairs as text: i-j, separated by spaces."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("-", p["i"].cast("string"), p["j"].cast("string"))), " ")


def to_pharaoh_scored(pairs: Column) -> Column:
    """Pairs with scores (structs i, j, tscore, ascore) as text: i-j:translation:alignment; scores below 0 are left out."""
    scores = lambda p: F.when(p["tscore"] >= 0, F.concat(F.lit(":"), _number(p["tscore"]), F.when(p["ascore"] >= 0, F.concat(F.lit(":"), _number(p["ascore"]))).otherwise(""))).otherwise("")
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["i"].cast("string"), F.lit("-"), p["j"].cast("string"), scores(p))), " ")


def from_pharaoh_scored(text: Column) -> Column:
    """Pairs of a text with their scores; a score that isn't there is -1."""
    score = lambda t, n: F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(n)).cast("double"), F.lit(-1.0))
    words = F.filter(F.split(text, " "), lambda t: t != "")
    plain = from_pharaoh(text)
    return F.zip_with(plain, words, lambda p, t: F.struct(p["i"].alias("i"), p["j"].alias("j"), score(t, 2).alias("tscore"), score(t, 3).alias("ascore")))


def from_pharaoh(text: Column) -> Column:
    """Pairs of a text; NULL stands for -1, scores after colons are left out."""
    number = lambda s: F.when(s == "NULL", F.lit(-1)).otherwise(s.cast("int"))
    part = lambda t, n: number(F.split_part(F.split_part(t, F.lit(":"), F.lit(1)), F.lit("-"), F.lit(n)))
    words = F.filter(F.split(text, " "), lambda t: t != "")
    return F.transform(words, lambda t: F.struct(part(t, 1).alias("i"), part(t, 2).alias("j")))
