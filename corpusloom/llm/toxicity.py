"""Toxicity scores by two Kneser-Ney bigram models, one of toxic and one of ordinary texts.

Of each class c (N counts words and pairs in all labelled training texts but those of the curve):

    P_c(w | h) = kept(N_c(h, w)) / N_c(h) + L_c(h) * U_c(w)      L_c(h): the mass that its pairs gave up
    U_c(w)     = kept(N_c(w)) / N_c       + L_c    * S(w)        L_c: the mass that its words gave up
    S(w)       = kept(C(w)) / C + D V / C * 1 / (V + 1)          C(w): different words before w, both classes

S, the continuation distribution, is shared: rare expressions are smoothed through it in either model.
kept() takes off a discount, D for expressions whose counts differ between the classes by more than
chance (likelihood ratio of at least `significant`), and the whole count for all others, which so take
the shared backoff in both. With significant = 0 every expression keeps its count less D: the plain
Kneser-Ney pair. Its chance differences drown few telling words among many neutral ones (README has
figures), hence the rule.

Copies must not make an expression telling: the ratio counts each class's occurrences at most once for
each different word before the expression.

As S cancels in the ratio of the models for all but telling words, the table of gains (log of toxic over
ordinary probability) is small. It is broadcast below a checked number of bytes; beyond it texts are
exploded and joined with it. A text's score is its gain over its number of words, put through a logistic
curve, which is fitted on a bounded sample of training texts that no count has seen.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, bounded, n_bytes, stash

#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: Least likelihood-ratio statistic of telling expressions: 1 in 100,000 by chance.
SIGNIFICANT = 19.5
#: Counts too small for that statistic's distribution to hold; rarer pairs aren't telling.
LEAST_COUNT = 3
#: Training texts that the logistic curve is fitted on at most, and the share left out of the counts for it.
CURVE_ROWS = 6000
CURVE_SHARE = 5
THRESHOLD = 0.3

WORD = re.compile(r"[^\W_]+")
_SCHEMA = "before string, word string, gain double"


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def of_curve() -> Column:
    """Training rows that the curve is fitted on; counts are of the others."""
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CURVE_SHARE)) == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the texts to learn from; a row with several labels is toxic if one says so."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    return docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text").join(bounded(known), "doc_id")


def _words() -> Column:
    return F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(texts: DataFrame) -> DataFrame:
    """(earlier, before, word, toxic), one row for each word; what is before a text's start is empty."""
    none = F.array(F.lit(""))
    rows = texts.select("toxic", _words().alias("w"))
    zipped = F.arrays_zip(F.concat(none, none, "w").alias("earlier"), F.concat(none, "w").alias("before"), F.col("w").alias("word"))
    return rows.select("toxic", F.explode(zipped)).select("toxic", "col.earlier", "col.before", "col.word").where("word is not null")


def _ratio(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Likelihood-ratio statistic of one expression's counts, a of n and b of m."""

    def part(k: Column, of: Column, share: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, p) + part(b, m, p) + part(n - a, n, 1 - p) + part(m - b, m, 1 - p))


def _kept(count: str) -> Column:
    return F.greatest(F.col(count) - DISCOUNT, F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, significant: float = SIGNIFICANT, least_count: int = LEAST_COUNT) -> DataFrame:
    """The table of gains (before, word, gain), one row for each

    - telling pair;
    - telling word, before being null;
    - word before telling pairs, word being null: what its other pairs' backoff adds to the next word's gain;
    - and one for all other words, before and word being null.

    No labelled texts, or those of one class: no rows.
    """
    texts = labelled(docs, labels).where(~of_curve())
    toxic, plain = F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    rows = _pairs(texts)
    counts = stash(rows.groupBy("before", "word").agg(toxic, plain), "toxicity-pairs")
    words = stash(counts.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("contexts"), F.count_if(F.col("a") > 0).alias("ca"), F.count_if(F.col("b") > 0).alias("cb")), "toxicity-words")
    total = words.agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum("contexts").alias("c"), F.count("*").alias("v")).first()
    if not total["n"] or not total["m"]:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    n, m, c, v = (F.lit(float(total[x])) for x in "nmcv")
    enough = (F.col("a") >= least_count) | (F.col("b") >= least_count)
    heads = counts.groupBy("before").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    of_pairs = (F.col("n") > 0) & (F.col("m") > 0)
    size = lambda x: F.col(x).cast("double")
    if significant <= 0:
        some = stash(words, "toxicity-some")
        pairs = stash(counts.join(heads, "before"), "toxicity-some-pairs")
    else:
        often = lambda n, m: (_ratio(F.col("a"), F.col("b"), n, m) >= significant)
        apart = lambda n, m: (_ratio(F.least("a", "ca"), F.least("b", "cb"), n, m) >= significant)
        some = stash(words.where(often(n, m) & apart(n, m)), "toxicity-some")
        pairs = counts.where(enough).join(heads.where(of_pairs), "before").where(often(size("n"), size("m")))
        pairs = stash(pairs, "toxicity-some-pairs")
        # Second reading: the different words before those, in each class.
        places = rows.join(bounded(pairs.select("before", "word")), ["before", "word"]).groupBy("before", "word", "earlier").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("o"))
        places = places.groupBy("before", "word").agg(F.sum("t").alias("ca"), F.sum("o").alias("cb"))
        pairs = pairs.join(places, ["before", "word"]).where(apart(size("n"), size("m")))
        pairs = stash(pairs.where((F.least("a", "ca") >= least_count) | (F.least("b", "cb") >= least_count)), "toxicity-telling-pairs")
    took = some.agg(F.coalesce(F.sum(_kept("a")), F.lit(0.0)).alias("a"), F.coalesce(F.sum(_kept("b")), F.lit(0.0)).alias("b")).first()
    left_t, left_o = F.lit(1 - took["a"] / total["n"]), F.lit(1 - took["b"] / total["m"])
    shared = (F.col("contexts") - DISCOUNT) / c + DISCOUNT * v / c / (v + 1)
    single = some.select("word", (_kept("a") / n + left_t * shared).alias("ut"), (_kept("b") / m + left_o * shared).alias("uo"))
    # What each first word's telling pairs leave to the backoff.
    left = pairs.groupBy("before").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum(_kept("a")).alias("ka"), F.sum(_kept("b")).alias("kb"))
    rest = lambda k, of: F.when(F.col(of) > 0, 1 - F.col(k) / F.col(of)).otherwise(1.0)
    left = stash(left.select("before", rest("ka", "n").alias("lt"), rest("kb", "m").alias("lo")), "toxicity-left")
    part = lambda k, of: F.when(F.col(of) > 0, _kept(k) / F.col(of)).otherwise(0.0)
    both = pairs.join(left, "before").join(words.select("word", "contexts"), "word").join(single, "word", "left")
    both = both.withColumn("ut", F.coalesce("ut", left_t * shared)).withColumn("uo", F.coalesce("uo", left_o * shared))
    both = both.select("before", "word", F.log((part("a", "n") + F.col("lt") * F.col("ut")) / (part("b", "m") + F.col("lo") * F.col("uo"))).alias("gain"))
    null = F.lit(None).cast("string")
    model = both.unionByName(single.select(null.alias("before"), "word", F.log(F.col("ut") / F.col("uo")).alias("gain")))
    model = model.unionByName(left.select("before", null.alias("word"), F.log(F.col("lt") / F.col("lo")).alias("gain")))
    base = docs.sparkSession.range(1).select(null.alias("before"), null.alias("word"), F.log(left_t / left_o).alias("gain"))
    return stash(model.unionByName(base), "toxicity-model")


class Table:
    """The gains as look-ups, in each task."""

    def __init__(self, rows: list[tuple[str | None, str | None, float]]):
        self.base = sum(g for h, w, g in rows if h is None and w is None)
        self.word = {w: g - self.base for h, w, g in rows if h is None and w is not None}
        self.left = {h: g for h, w, g in rows if h is not None and w is None}
        self.pair: dict[str, dict[str, float]] = {}
        for h, w, g in rows:
            if h is not None and w is not None:
                self.pair.setdefault(h, {})[w] = g - self.base

    def gain(self, text: str | None) -> tuple[float, int]:
        """Sum of gains and number of words."""
        words = WORD.findall(text.lower()) if text else []
        word, left, pair = self.word, self.left, self.pair
        total = sum([word[w] for w in words if w in word])
        for i in [i for i, h in enumerate(["", *words[:-1]]) if h in left] if words else ():
            h, w = words[i - 1] if i else "", words[i]
            alone = word.get(w, 0.0)
            total += pair[h].get(w, left[h] + alone) - alone
        return total + self.base * len(words), len(words)


def gains(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs' doc_id, held_out and, if there is one, toxic, with gain (sum) and n_words of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", held_out().alias("held_out"), "text", *([] if "toxic" not in docs.columns else ["toxic"]))
    rest = ", toxic int" if "toxic" in docs.columns else ""
    if n_bytes(model) <= BROADCAST_BYTES:
        table = docs.sparkSession.sparkContext.broadcast(Table([tuple(r) for r in model.collect()]))

        def run(batch):
            got = [table.value.gain(t) for t in batch.column(2).to_pylist()]
            out = {"doc_id": batch.column(0), "held_out": batch.column(1), "gain": [g for g, _ in got], "n_words": [k for _, k in got]}
            return out | ({"toxic": batch.column(3)} if rest else {})

        return arrow_map(base, run, f"doc_id {kind}, held_out boolean, gain double, n_words bigint{rest}")
    return joined_gains(base, model)


def joined_gains(base: DataFrame, model: DataFrame) -> DataFrame:
    """The same by joins, for a model of any size. Rows are told apart by an id of their own."""
    rest = [c for c in base.columns if c != "text"]
    base = stash(base.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    listed = base.select("row", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w"))
    words = listed.select("row", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("before"), F.col("w").alias("word"))).alias("x")).select("row", "x.before", "x.word").where("word is not null")
    of_word = model.where("before is null and word is not null").select("word", F.col("gain").alias("g1"))
    of_pair = model.where("before is not null and word is not null").select("before", "word", F.col("gain").alias("g2"))
    of_head = model.where("before is not null and word is null").select("before", F.col("gain").alias("g3"))
    others = model.where("before is null and word is null").agg(F.sum("gain")).first()[0] or 0.0
    each = F.coalesce("g2", F.coalesce("g1", F.lit(others)) + F.coalesce("g3", F.lit(0.0)))
    sums = words.join(of_word, "word", "left").join(of_pair, ["before", "word"], "left").join(of_head, "before", "left").groupBy("row").agg(F.sum(each).alias("gain"), F.count("*").alias("n_words"))
    out = base.drop("text").join(sums, "row", "left")
    return out.select(*rest, F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def curve(docs: DataFrame, labels: DataFrame, model: DataFrame, rows: int = CURVE_ROWS) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on a bounded sample of the texts left for it."""
    texts = labelled(docs, labels).where(of_curve())
    n = labels.count() / CURVE_SHARE
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, n))) + 1
    got = gains(texts.where(part).select("doc_id", "text", "toxic"), model).select("gain", "n_words", "toxic").limit(2 * rows).collect()
    if not got or len({r["toxic"] for r in got}) < 2:
        return 10.0, -2.0
    x = np.array([[r["gain"] / max(1, r["n_words"]), 1.0] for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    scale = max(x[:, 0].std(), 1e-9)
    x[:, 0] /= scale
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w), -2, 2)
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: DataFrame, slope: float, offset: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts score as texts without any telling word. Rows are scored one by one, so
    repeated rows get equal scores and an empty table gives an empty one; other columns are not read.
    """
    z = F.lit(slope) * F.col("gain") / F.greatest("n_words", F.lit(1)) + F.lit(offset)
    out = gains(docs.select("doc_id", "text"), model).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then score all rows of docs."""
    model = train(docs, labels)
    return score(docs, model, *curve(docs, labels, model))
