"""Row operations of text corpora: filters, limits, splits, unions, counts.

A corpus is a DataFrame with text_id, ref, segment (array of tokens) and further columns. DataFrames
have no order, so what is "first" goes by the columns given as order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of hashes that split() counts the values of at once.
SPLIT_BITS = 12


def where_nonempty(corpus: DataFrame, *sides: str) -> DataFrame:
    """Rows whose segments (all that are named) have tokens."""
    return corpus.where(reduce(lambda a, b: a & b, [F.coalesce(F.size(s), F.lit(0)) > 0 for s in sides or ("segment",)]))


def filter_texts(corpus: DataFrame, ids: DataFrame | Sequence[str] | None) -> DataFrame:
    """Rows of the texts with those ids; None keeps all."""
    if ids is None:
        return corpus
    if isinstance(ids, DataFrame):
        return corpus.join(ids.select("text_id").distinct(), "text_id", "left_semi")
    return corpus.where(F.col("text_id").isin(list(ids)))


def exclude_texts(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    return corpus.join(ids.select("text_id").distinct(), "text_id", "left_anti")


def with_index(corpus: DataFrame, order: Sequence[str], within: Sequence[str], name: str = "index", parts: int = 200) -> DataFrame:
    """corpus with each row's number, from 0, in its text (or other group).

    If the first column of the order is a number, rows are dealt to ranges of it, so that a large text is
    no single task: numbers run within ranges, and start at the rows that the ranges before hold.
    """
    if corpus.schema[order[0]].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double"):
        return corpus.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)
    cuts = corpus.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 10 * parts).alias("x")).first()["x"] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(order[0])))
    rows = corpus.withColumn("__part", F.when(F.col(order[0]).isNull(), -1).otherwise(at))
    sizes = rows.groupBy(*within, "__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__part").alias("__at"), before.alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within], F.col("__part") == F.col("__at"))
    number = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order)) - 1
    out = rows.withColumn(name, number).join(starts, same)
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__at", "__before", *[f"__{c}" for c in within])


def batches(corpus: DataFrame, n: int, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """corpus with batch: rows in order, n by n, numbered from 0 in each text (or other group)."""
    return with_index(corpus, order, within, "batch").withColumn("batch", F.floor(F.col("batch") / n).cast("bigint"))


def zip_many(corpora: Sequence[DataFrame], order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows with equal places in their texts side by side, as struct columns r0, r1 ...; the shortest text ends it."""
    place = "__place"
    sides = []
    for i, c in enumerate(corpora):
        rows = with_index(c, order, within, place)
        sides.append(rows.select(*within, place, F.struct(*[F.col(x) for x in c.columns if x not in within]).alias(f"r{i}")))
    return reduce(lambda a, b: a.join(b, [*within, place]), sides).withColumnRenamed(place, "place")


def common_texts(corpora: Sequence[DataFrame]) -> DataFrame:
    """text_id of the texts that all corpora have."""
    return reduce(lambda a, b: a.intersect(b), [c.select("text_id") for c in corpora])


def all_texts(corpora: Sequence[DataFrame]) -> DataFrame:
    """text_id of the texts that some corpus has."""
    return reduce(lambda a, b: a.union(b), [c.select("text_id") for c in corpora]).distinct()


def except_refs(corpus: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of corpus whose references the other lacks."""
    return corpus.join(other.select("text_id", "ref").distinct(), ["text_id", "ref"], "left_anti")


def transform(corpus: DataFrame, *processors) -> DataFrame:
    """corpus after each processor, a function of the segment column, in turn; without any, as it is."""
    return corpus.withColumn("segment", reduce(lambda c, f: f(c), processors, F.col("segment"))) if processors else corpus


def sentence_starts(corpus: DataFrame, order: Sequence[str], text: str = "text", within: str = "text_id") -> DataFrame:
    """corpus with starts: whether the row before ends a sentence; the first row of a text starts one."""
    from ..functions.text import has_sentence_ending

    before = F.lag(has_sentence_ending(F.col(text))).over(Window.partitionBy(within).orderBy(*order))
    return corpus.withColumn("starts", F.coalesce(before, F.lit(True)))


def islands(corpus: DataFrame, key: str, order: Sequence[str], within: str = "text_id") -> DataFrame:
    """corpus with island: rows in order that follow each other with equal keys have one number, from 1."""
    w = Window.partitionBy(within).orderBy(*order)
    starts = (~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("int")
    return corpus.withColumn("__starts", starts).withColumn("island", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def take(corpus: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in an order; each partition hands on n rows at most."""
    return corpus.orderBy(*order).limit(n)


def flatten(corpora: Sequence[DataFrame], name: str = "corpus_no") -> DataFrame:
    """All rows of the corpora, one corpus after another by the number in name."""
    return reduce(DataFrame.unionByName, [c.withColumn(name, F.lit(i)) for i, c in enumerate(corpora)])


def split(corpus: DataFrame, key: Column, percent: float | None = None, size: int | None = None, seed: int = 31415, include_empty: bool = True) -> DataFrame:
    """corpus with is_split: a drawn share of percent, but no more than size rows; 10 % if neither is given.

    Rows are drawn by a seeded hash of their key, so the draw doesn't depend on the partitions. The
    exact number is the share of the counted rows, rounded down, cut off at a threshold hash.
    """
    percent = 0.1 if percent is None and size is None else percent
    can = F.lit(True) if include_empty else F.size("segment") > 0
    rows = corpus.withColumn("__draw", F.when(can, F.xxhash64(F.lit(seed), key)))
    total = rows.where(F.col("__draw").isNotNull()).count()
    n = min(x for x in (int(total * percent) if percent is not None else total, size if size is not None else total))
    if n <= 0:
        return rows.withColumn("is_split", F.lit(False)).drop("__draw")
    # The threshold hash, from its highest bits on: each step counts the even parts of the range that it lies in, so that what
    # passes through the driver is 2 ** SPLIT_BITS counts a step, for any number of rows.
    low, width, before = -(1 << 63), 64, 0
    while width > 0:
        width = max(0, width - SPLIT_BITS)
        inside = rows.where(F.col("__draw") >= low) if low + (1 << min(64, width + SPLIT_BITS)) >= 1 << 63 else rows.where(F.col("__draw").between(low, low + (1 << width + SPLIT_BITS) - 1))
        counts = inside.groupBy(F.shiftright("__draw", width).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        for r in counts:
            if before + r["n"] >= n:
                low, here = r["part"] << width, r["n"]
                break
            before += r["n"]
        if before + here == n and width:  # all of this part are drawn: its end is the threshold
            low += (1 << width) - 1
            break
    last, extra = low, before + here - n
    drawn = F.coalesce(F.col("__draw") <= last, F.lit(False))
    if extra > 0:  # equal hashes: so many of them stay out
        tied = F.row_number().over(Window.partitionBy("__draw").orderBy(*[c for c in ("text_id", "ref") if c in corpus.columns]))
        some = rows.where(F.col("__draw") == last).withColumn("__rank", tied).withColumn("is_split", F.col("__rank") > extra).drop("__rank")
        rest = rows.where(~F.col("__draw").eqNullSafe(F.lit(last))).withColumn("is_split", drawn)
        return rest.unionByName(some).drop("__draw")
    return rows.withColumn("is_split", drawn).drop("__draw")


def invert(parallel: DataFrame) -> DataFrame:
    """Source and target exchanged, in aligned pairs too."""
    swapped = {"source_refs": "target_refs", "target_refs": "source_refs", "source_segment": "target_segment", "target_segment": "source_segment", "sflags": "tflags", "tflags": "sflags"}
    out = parallel.select(*[F.col(c).alias(swapped.get(c, c)) for c in parallel.columns])
    if "pairs" in out.columns:
        out = out.withColumn("pairs", F.transform("pairs", lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))))
    return out.select(*parallel.columns)


def count(corpus: DataFrame, include_empty: bool = True) -> DataFrame:
    """Rows of each text."""
    return corpus.groupBy("text_id").agg((F.count("*") if include_empty else F.count_if(F.size("segment") > 0)).alias("n_rows"))


def corpus_stats(parallel: DataFrame, longest: int = 200) -> DataFrame:
    """Segments, words of either side, their means, and segments with a side over the longest length."""
    s, t = F.size("source_segment"), F.size("target_segment")
    return parallel.agg(
        F.count("*").alias("n_segments"),
        F.sum(s.cast("bigint")).alias("source_words"),
        F.sum(t.cast("bigint")).alias("target_words"),
        F.round(F.avg(s), 6).alias("source_mean"),
        F.round(F.avg(t), 6).alias("target_mean"),
        F.count_if((s > longest) | (t > longest)).alias("n_long"),
    )
