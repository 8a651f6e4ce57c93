"""Frequency and probability distributions, n-gram models and measures of distance.

Distributions are tables (condition columns, sample, cnt); every function adds columns by windows over
the conditions, or joins where a window would gather one condition's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(samples: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Counts of the columns' values; with a weight, its sum (increments and decrements). Zeros go."""
    counts = samples.groupBy(*by).agg((F.sum(weight) if weight else F.count("*")).cast("bigint").alias("cnt"))
    return counts.where("cnt <> 0")


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """counts with the number n, the kinds t and, joined by condition, so that partial sums do the work."""
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("n"), F.count("*").alias("t"))
    if not by:
        return counts.crossJoin(F.broadcast(totals))  # one row
    return counts.join(totals, list(by))


def max_likelihood(counts: DataFrame, *by: str) -> DataFrame:
    """counts with prob = cnt / n."""
    return _totals(counts, by).withColumn("prob", F.col("cnt") / F.col("n")).drop("n", "t")


def lidstone(counts: DataFrame, *by: str, gamma: float = 0.5, extra_bins: int = 1) -> DataFrame:
    """prob = (cnt + gamma) / (n + B gamma), B the kinds and some more; unseen is what a new kind gets."""
    bins = F.col("t") + extra_bins
    rows = _totals(counts, by).withColumn("__d", F.col("n") + bins * gamma)
    return rows.withColumn("prob", (F.col("cnt") + gamma) / F.col("__d")).withColumn("unseen", gamma / F.col("__d")).drop("n", "t", "__d")


def witten_bell(counts: DataFrame, *by: str, extra_bins: int = 1) -> DataFrame:
    """prob = cnt / (n + t); unseen = t / (Z (n + t)) with Z bins that hold nothing."""
    rows = _totals(counts, by)
    unseen = F.col("t") / (F.lit(float(extra_bins)) * (F.col("n") + F.col("t")))
    return rows.withColumn("prob", F.col("cnt") / (F.col("n") + F.col("t"))).withColumn("unseen", unseen).drop("n", "t")


def good_turing(counts: DataFrame) -> DataFrame:
    """(cnt, smoothed, switched) of the simple Good-Turing estimate, one row for each count that occurs.

    Counts of counts are averaged over their gaps, a line is fitted to their logarithms, and from the
    first count on where both estimates agree within 1.96 standard deviations, or the next count is
    missing, the line is used. This table is as small as the number of different counts.
    """
    nr = counts.groupBy(F.col("cnt").alias("r")).agg(F.count("*").cast("double").alias("nr"))
    w = Window.orderBy("r")  # over different counts only
    gaps = nr.withColumn("q", F.lag("r").over(w)).withColumn("s", F.lead("r").over(w)).withColumn("next_nr", F.lead("nr").over(w))
    last = F.col("s").isNull()
    low = F.coalesce("q", F.lit(0))
    zr = F.when(last, F.col("nr") / (F.col("r") - low)).otherwise(2 * F.col("nr") / (F.col("s") - low))
    gaps = gaps.withColumn("x", F.ln("r")).withColumn("y", F.ln(zr))
    line = gaps.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"))
    rows = gaps.crossJoin(F.broadcast(line))  # one row
    smooth = lambda r: F.exp(F.col("base") + F.col("slope") * F.ln(r))
    r = F.col("r")
    by_line = (r + 1) * smooth(r + 1) / smooth(r)
    rows = rows.withColumn("by_line", by_line)
    has_next = F.col("s") == r + 1
    direct = (r + 1) * F.col("next_nr") / F.col("nr")
    spread = F.sqrt((r + 1) * (r + 1) * F.col("next_nr") / (F.col("nr") * F.col("nr")) * (1 + F.col("next_nr") / F.col("nr")))
    use_line = F.coalesce(~has_next | (F.abs(direct - F.col("by_line")) <= 1.96 * spread), F.lit(True))
    rows = rows.withColumn("switched", F.max(use_line.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return rows.select(r.alias("cnt"), F.when(F.col("switched"), F.col("by_line")).otherwise(direct).alias("smoothed"), "switched", "nr")


def good_turing_probability(counts: DataFrame, extra_bins: int = 1) -> DataFrame:
    """counts with prob and unseen; what samples seen once hold is set aside for unseen ones."""
    table = good_turing(counts)
    sums = table.agg(F.sum(F.col("nr") * F.col("cnt")).alias("n"), F.sum(F.when(F.col("cnt") == 1, F.col("nr")).otherwise(0.0)).alias("n1"), F.sum(F.col("nr") * F.col("smoothed")).alias("mass"))
    p0 = F.col("n1") / F.col("n")
    table = table.crossJoin(F.broadcast(sums))  # one row
    table = table.select("cnt", ((1 - p0) * F.col("smoothed") / F.col("mass")).alias("prob"), (p0 / extra_bins).alias("unseen"))
    return counts.join(F.broadcast(table), "cnt").select(*counts.columns, "prob", "unseen")


def ngrams(tokens: Column, n: int, right_to_left: bool = False) -> Column:
    """All n-grams of an array of tokens; read backwards on demand, so that the context follows."""
    seq = F.reverse(tokens) if right_to_left else tokens
    return F.when(F.size(seq) >= n, F.transform(F.sequence(F.lit(1), F.size(seq) - n + 1), lambda i: F.slice(seq, i, n))).otherwise(F.array().cast("array<array<string>>"))


def ngram_counts(corpus: DataFrame, n: int, tokens: str = "tokens", right_to_left: bool = False) -> DataFrame:
    """(context, word, cnt), context being the n-gram's first n - 1 tokens."""
    rows = corpus.select(F.explode(ngrams(F.col(tokens), n, right_to_left)).alias("g"))
    return rows.groupBy(F.slice("g", 1, n - 1).alias("context"), F.element_at("g", n).alias("word")).agg(F.count("*").alias("cnt"))


def ngram_max_likelihood(corpus: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    return max_likelihood(ngram_counts(corpus, n, tokens), "context")


def ngram_witten_bell(corpus: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """Interpolated Witten-Bell probabilities of all n-grams seen, down to single words."""
    rows = max_likelihood(ngram_counts(corpus, 1, tokens), "context").select("context", "word", "cnt", "prob")
    for k in range(2, n + 1):
        lower = rows.select(F.col("context").alias("shorter"), F.col("word").alias("w"), F.col("prob").alias("below"))
        up = _totals(ngram_counts(corpus, k, tokens), ["context"]).withColumn("shorter", F.slice("context", 2, max(k - 2, 0)) if k > 2 else F.array().cast("array<string>"))
        up = up.join(lower, (up["shorter"] == lower["shorter"]) & (up["word"] == lower["w"]))
        rows = up.select("context", "word", "cnt", ((F.col("cnt") + F.col("t") * F.col("below")) / (F.col("n") + F.col("t"))).alias("prob"))
    return rows


def ngram_kneser_ney(corpus: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """Modified Kneser-Ney with three discounts of the counts of counts, over raw counts in every order."""
    rows = max_likelihood(ngram_counts(corpus, 1, tokens), "context").select("context", "word", "cnt", "prob")
    for k in range(2, n + 1):
        counts = ngram_counts(corpus, k, tokens)
        c = counts.agg(*[F.coalesce(F.count_if(F.col("cnt") == i), F.lit(0)).cast("double").alias(f"c{i}") for i in range(1, 5)])
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        part = lambda i: F.when(F.col(f"c{i}") > 0, i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}")).otherwise(0.0)
        d = c.select(part(1).alias("d1"), part(2).alias("d2"), part(3).alias("d3"))
        of = counts.groupBy("context").agg(F.sum("cnt").alias("n"), *[F.count_if(F.col("cnt") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("cnt") > 2).alias("n3"))
        lower = rows.select(F.col("context").alias("shorter"), F.col("word").alias("w"), F.col("prob").alias("below"))
        up = counts.join(of, "context").crossJoin(F.broadcast(d))  # one row
        up = up.withColumn("shorter", F.slice("context", 2, k - 2) if k > 2 else F.array().cast("array<string>"))
        up = up.join(lower, (up["shorter"] == lower["shorter"]) & (up["word"] == lower["w"]))
        off = F.when(F.col("cnt") == 1, F.col("d1")).when(F.col("cnt") == 2, F.col("d2")).otherwise(F.col("d3"))
        back = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("n")
        rows = up.select("context", "word", "cnt", ((F.col("cnt") - off) / F.col("n") + back * F.col("below")).alias("prob"))
    return rows


def train_all(corpus: DataFrame, n: int, train=ngram_kneser_ney, tokens: str = "tokens") -> list[DataFrame]:
    """Models of orders 1 to n of one corpus."""
    return [train(corpus, k, tokens) for k in range(1, n + 1)]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is all zeros."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def kullback_leibler(p: Column, q: Column) -> Column:
    """In bits; a term with a zero on either side is 0."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def jensen_shannon(p: Column, q: Column) -> Column:
    mean = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return kullback_leibler(p, mean) / 2 + kullback_leibler(q, mean) / 2


def divergences(probs: DataFrame, key: str, sample: str) -> DataFrame:
    """(one, two, js): Jensen-Shannon divergence in bits of each two distributions of (key, sample, prob).

    Only samples that both have are joined. A sample of one side alone adds half its probability there,
    all of which is 1 less what the shared ones have.
    """
    one = probs.select(F.col(key).alias("one"), sample, F.col("prob").alias("p"))
    two = probs.select(F.col(key).alias("two"), sample, F.col("prob").alias("q"))
    mean = (F.col("p") + F.col("q")) / 2
    both = one.join(two, sample).where("one < two").groupBy("one", "two").agg(F.sum(F.col("p") * F.log2(F.col("p") / mean) + F.col("q") * F.log2(F.col("q") / mean)).alias("s"), F.sum(F.col("p") + F.col("q")).alias("shared"))
    keys = probs.groupBy(key).agg(F.count("*").alias("n")).where("n > 0")  # one row for each distribution
    pairs = keys.select(F.col(key).alias("one")).join(keys.select(F.col(key).alias("two")), F.col("one") < F.col("two"))
    out = pairs.join(both, ["one", "two"], "left")
    return out.select("one", "two", ((F.coalesce("s", F.lit(0.0)) + 2 - F.coalesce("shared", F.lit(0.0))) / 2).alias("js"))


def geometric_mean(value: Column) -> Column:
    """An aggregate: 0 if there is no value or one that isn't positive."""
    return F.when(F.min(value) > 0, F.exp(F.avg(F.ln(F.when(value > 0, value))))).otherwise(0.0)


#: The logarithm of zero. Fixed value.
LOG_ZERO = -999_999_999.0


def log_add(a: Column, b: Column) -> Column:
    """The logarithm of the sum of two numbers given by their logarithms."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low <= LOG_ZERO, high).otherwise(high + F.log1p(F.exp(low - high)))


def log_divide(a: Column, b: Column) -> Column:
    return F.when(a <= LOG_ZERO, F.lit(LOG_ZERO)).otherwise(a - b)


def log_multiply(a: Column, b: Column) -> Column:
    return F.when((a <= LOG_ZERO) | (b <= LOG_ZERO), F.lit(LOG_ZERO)).otherwise(a + b)
