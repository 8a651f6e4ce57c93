"""Evaluation of translations and alignments, and estimates of usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import geometric_mean, ngrams


def bleu(rows: DataFrame, hypothesis: str, reference: str, order: int = 4) -> DataFrame:
    """One row: corpus BLEU of up to order-grams, with clipped matches and the brevity penalty.

    Precisions are global, so only counts meet: n-grams of one segment are counted within its row.
    """
    grams = lambda c: F.flatten(F.array(*[ngrams(F.col(c), n) for n in range(1, order + 1)]))
    ids = rows.select(F.monotonically_increasing_id().alias("row"), hypothesis, reference)
    side = lambda c, name: ids.select("row", F.explode(grams(c)).alias("g")).groupBy("row", "g").agg(F.count("*").alias(name))
    both = side(hypothesis, "h").join(side(reference, "r"), ["row", "g"], "left")
    per = both.groupBy(F.size("g").alias("n")).agg(F.sum("h").alias("total"), F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("same"))
    lengths = rows.agg(F.sum(F.size(hypothesis)).alias("hyp"), F.sum(F.size(reference)).alias("ref"))
    logs = per.agg(F.sum(F.when(F.col("same") > 0, F.ln(F.col("same") / F.col("total")))).alias("logs"), F.count_if(F.col("same") > 0).alias("found"))
    brevity = F.when(F.col("hyp") >= F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.col("hyp")))
    return logs.crossJoin(lengths).select(F.when(F.col("found") == order, brevity * F.exp(F.col("logs") / order)).otherwise(0.0).alias("bleu"))  # one row each


def alignment_scores(alignments: DataFrame, gold: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row: alignment error rate, precision, recall and F-score of pairs (key, i, j), gold with sure.

    Gold pairs that aren't sure are possible; sure ones are possible too.
    """
    key = [c for c in gold.columns if c not in ("i", "j", "sure")]
    found = alignments.select(*key, "i", "j").distinct().withColumn("a", F.lit(True))
    known = gold.groupBy(*key, "i", "j").agg(F.max("sure").alias("sure"), F.lit(True).alias("p"))
    n = found.join(known, [*key, "i", "j"], "full").agg(
        F.count_if("a").alias("a"), F.count_if("sure").alias("s"), F.count_if(F.col("a") & F.col("p")).alias("ap"), F.count_if(F.col("a") & F.col("sure")).alias("sa")
    )
    precision, recall = F.try_divide("ap", "a"), F.try_divide("sa", "s")
    score = F.try_divide(F.lit(1.0), alpha / precision + (1 - alpha) / recall)
    return n.select((1 - F.try_divide(F.col("ap") + F.col("sa"), F.col("s") + F.col("a"))).alias("aer"), precision.alias("precision"), recall.alias("recall"), score.alias("f_score"))


#: Usable and unusable segments' ChrF3: mean, variance and number. Fixed values.
USABLE = (51.4, 95.19, 263.0)
UNUSABLE = (45.85, 99.91, 97.0)
#: Usability from which a text is green, or yellow; else it is red. Fixed values.
GREEN, YELLOW = 0.776, 0.681


def usability(chrf3: Column, usable=USABLE, unusable=UNUSABLE) -> Column:
    """The share of usable segments among those with a ChrF3, by two weighted bell curves."""
    weight = lambda m, v, n: n * F.exp(-((chrf3 - m) ** 2) / (2 * v))
    good, bad = weight(*usable), weight(*unusable)
    return good / (good + bad)


def usability_label(value: Column) -> Column:
    return F.when(value >= GREEN, "Green").when(value >= YELLOW, "Yellow").otherwise("Red")


def chrf3_estimates(segments: DataFrame, slope: float, intercept: float, *by: str) -> DataFrame:
    """Per group: geometric mean of confidence, projected ChrF3, mean usability and its label."""
    projected = lambda c: slope * c + intercept
    per = segments.withColumn("usable", usability(projected(F.col("confidence"))))
    out = per.groupBy(*by).agg(geometric_mean(F.col("confidence")).alias("confidence"), F.avg("usable").alias("usability"))
    return out.select(*by, "confidence", projected(F.col("confidence")).alias("chrf3"), "usability", usability_label(F.col("usability")).alias("label"))


def low_confidence(confidence: Column, least: float = 0.42) -> Column:
    """Whether a book's confidence is too low; one outside 0 to 1 is an error."""
    return F.when(confidence.between(0, 1), confidence < least).otherwise(F.raise_error(F.lit("a confidence must be from 0 to 1")))


def suggestion_metrics(rows: DataFrame) -> DataFrame:
    """One row of (actions, characters, suggestions, accepted, full, initial, final, middle) by segment, added up.

    ksmr: actions over characters that were to be typed; precision: accepted over all suggestions; the
    shares of accepted suggestions that were whole, or the beginning, end or middle of what was accepted.
    """
    sums = rows.agg(*[F.sum(c).alias(c) for c in ("actions", "characters", "suggestions", "accepted", "full", "initial", "final", "middle")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select(share("actions", "characters").alias("ksmr"), share("accepted", "suggestions").alias("precision"), *[share(c, "accepted").alias(f"{c}_share") for c in ("full", "initial", "final", "middle")])
