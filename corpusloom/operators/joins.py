"""Alignment of corpora by reference: two-way and N-way, with ranges, and choice among them.

flags of a row, added up: 1 sentence start, 2 in range, 4 range start. A text in a range has its words
in the range's first row; the range's other rows are empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTENCE_START, IN_RANGE, RANGE_START = 1, 2, 4

_HOW = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}


def align_rows(source: DataFrame, target: DataFrame, all_source: bool = False, all_target: bool = False) -> DataFrame:
    """Rows with equal text_id and ref, side by side; equal refs pair with each other in all ways.

    The switches keep rows of one side that the other lacks, with an empty segment on that side.
    """
    s = source.select("text_id", "ref", F.col("segment").alias("source_segment"), F.lit(True).alias("has_source"))
    t = target.select("text_id", "ref", F.col("segment").alias("target_segment"), F.lit(True).alias("has_target"))
    both = s.join(t, ["text_id", "ref"], _HOW[all_source, all_target])
    none = F.array().cast("array<string>")
    refs = lambda has: F.when(F.col(has), F.array("ref")).otherwise(F.array().cast(f"array<{source.schema['ref'].dataType.simpleString()}>"))
    return both.select("text_id", "ref", refs("has_source").alias("source_refs"), refs("has_target").alias("target_refs"), F.coalesce("source_segment", none).alias("source_segment"), F.coalesce("target_segment", none).alias("target_segment"))


def align_ranges(source: DataFrame, target: DataFrame, all_source: bool = False, all_target: bool = False) -> DataFrame:
    """align_rows for corpora with ranges: rows of a range become one, references and words put together.

    Refs must be unique in each corpus. A range of one side gathers the other side's rows unless that
    side keeps all rows. Within a text, rows are in the order of ref; the running number of starts gives
    each group its name, so a group is gathered by an aggregation.
    """
    s = source.select("text_id", "ref", F.col("segment").alias("ss"), F.col("flags").alias("sf"))
    t = target.select("text_id", "ref", F.col("segment").alias("ts"), F.col("flags").alias("tf"))
    both = s.join(t, ["text_id", "ref"], "full")
    in_s, in_t = (F.coalesce(F.col(f).bitwiseAND(IN_RANGE) > 0, F.lit(False)) for f in ("sf", "tf"))
    fresh = lambda f: F.col(f).isNull() | (F.col(f).bitwiseAND(IN_RANGE) == 0) | (F.col(f).bitwiseAND(RANGE_START) > 0)
    has_s, has_t = F.col("sf").isNotNull(), F.col("tf").isNotNull()
    gathers = (in_s & F.lit(not all_target)) | (in_t & F.lit(not all_source))
    one_sided = ~(has_s & has_t)
    kept = F.when(~one_sided, F.lit(True)).otherwise(gathers | (has_s & F.lit(all_source)) | (has_t & F.lit(all_target)))
    rows = both.withColumn("gathers", gathers).where(kept)
    starts = F.when(~F.col("gathers"), F.lit(True)).when(one_sided, F.lit(False)).otherwise(fresh("sf") & fresh("tf"))
    order = Window.partitionBy("text_id").orderBy("ref")
    rows = rows.withColumn("starts", starts)
    after_single = F.coalesce(~F.lag("gathers").over(order), F.lit(True))  # a row by itself ends what was before
    rows = rows.withColumn("group", F.sum((F.col("starts") | after_single).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sides = lambda c, f: F.expr(f"transform(filter(array_sort(collect_list(struct(ref, {c} as seg, {f} as f))), x -> x.f is not null), x -> x)")
    got = rows.groupBy("text_id", "group").agg(sides("ss", "sf").alias("s"), sides("ts", "tf").alias("t"), F.min("ref").alias("ref"))
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["seg"]))
    return got.select("text_id", "ref", F.transform("s", lambda x: x["ref"]).alias("source_refs"), F.transform("t", lambda x: x["ref"]).alias("target_refs"), flat("s").alias("source_segment"), flat("t").alias("target_segment"))


def align_many(corpora: Sequence[DataFrame], all_rows: Sequence[bool]) -> DataFrame:
    """N corpora by reference: (text_id, ref, segments), segments having one entry for each corpus.

    Rows with equal references meet in all ways, so n and m rows of two corpora give n * m rows. A
    reference stays if each corpus has it, or if one that keeps all rows has it; segments of corpora that
    lack it are empty. Corpora without whom a row can't stay are joined first, inner, so no row is kept
    that the end would drop.
    """
    on, none = ["text_id", "ref"], F.array().cast("array<string>")
    sides = [c.select(*on, F.coalesce("segment", none).alias(f"s{i}"), F.lit(True).alias(f"h{i}")) for i, c in enumerate(corpora)]
    kept = [i for i, keep in enumerate(all_rows) if keep]
    if kept:
        first = [i for i in range(len(sides)) if i in kept]
        rows = reduce(lambda x, i: x.join(sides[i], on, "full"), first[1:], sides[first[0]])
        # Beside those, rows that all the others have too are rows of the first ones already.
        rows = reduce(lambda x, i: x.join(sides[i], on, "left"), [i for i in range(len(sides)) if i not in kept], rows)
    else:
        rows = reduce(lambda x, y: x.join(y, on), sides)
    return rows.select(*on, F.array(*[F.coalesce(f"s{i}", none) for i in range(len(sides))]).alias("segments"))


def first_rows(corpus: DataFrame) -> DataFrame:
    """One row for each reference: of equal ones that with the least segment."""
    return corpus.groupBy("text_id", "ref").agg(F.min("segment").alias("segment"))


def choose_first(corpora: Sequence[DataFrame]) -> DataFrame:
    """Each reference's first non-empty segment, and the corpus that it is from (-1: all are empty)."""
    rows = align_many([first_rows(c) for c in corpora], [True] * len(corpora))
    at = F.array_position(F.transform("segments", lambda s: F.size(s) > 0), F.lit(True)).cast("int") - 1
    rows = rows.withColumn("corpus_no", at)
    return rows.select("text_id", "ref", F.when(F.col("corpus_no") >= 0, F.expr("segments[corpus_no]")).otherwise(F.array().cast("array<string>")).alias("segment"), "corpus_no")


def choose_random(corpora: Sequence[DataFrame], seed: int) -> DataFrame:
    """A drawn non-empty segment of each reference, by a seeded hash of the reference."""
    rows = align_many([first_rows(c) for c in corpora], [True] * len(corpora))
    full = F.filter(F.transform("segments", lambda s, i: F.struct(i.alias("n"), s.alias("s"))), lambda x: F.size(x["s"]) > 0)
    rows = rows.withColumn("full", full)
    one = F.when(F.size("full") > 0, F.element_at("full", (F.pmod(F.xxhash64(F.lit(seed), "text_id", "ref"), F.size("full")) + 1).cast("int")))
    return rows.select("text_id", "ref", F.coalesce(one["s"], F.array().cast("array<string>")).alias("segment"), F.coalesce(one["n"], F.lit(-1)).alias("corpus_no"))


def align_many_ranges(corpora: Sequence[DataFrame], all_rows: Sequence[bool]) -> DataFrame:
    """align_many for corpora with ranges (column flags): rows of a range become one in all corpora.

    (text_id, ref, refs, segments): refs and segments have an array for each corpus. A range goes on while
    a corpus is within it, and ranges that overlap make one; it gathers the rows of all corpora unless all
    other corpora keep all of theirs. Refs must be unique in each corpus.
    """
    on, n = ["text_id", "ref"], len(corpora)
    kind = corpora[0].schema["ref"].dataType.simpleString()
    sides = [c.select(*on, F.struct(F.col("segment").alias("s"), F.col("flags").alias("f")).alias(f"c{i}")) for i, c in enumerate(corpora)]
    rows = reduce(lambda x, y: x.join(y, on, "full"), sides)
    has = [F.col(f"c{i}").isNotNull() for i in range(n)]
    within = [F.coalesce(F.col(f"c{i}.f").bitwiseAND(IN_RANGE) > 0, F.lit(False)) for i in range(n)]
    opens = [F.coalesce(F.col(f"c{i}.f").bitwiseAND(RANGE_START) > 0, F.lit(False)) for i in range(n)]
    # A range gathers the rows of corpora that don't keep all of theirs.
    gathers = reduce(lambda x, y: x | y, [within[i] & F.lit(not all(all_rows[j] for j in range(n) if j != i)) for i in range(n)])
    every = reduce(lambda x, y: x & y, has)
    stays = reduce(lambda x, y: x | y, [h for h, keep in zip(has, all_rows, strict=True) if keep], every | gathers)
    continues = reduce(lambda x, y: x | y, [w & ~o for w, o in zip(within, opens, strict=True)])
    rows = rows.where(stays).withColumn("gathers", gathers).withColumn("starts", ~gathers | ~continues)
    order = Window.partitionBy("text_id").orderBy("ref")
    single = F.coalesce(~F.lag("gathers").over(order), F.lit(True))
    rows = rows.withColumn("group", F.sum((F.col("starts") | single).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = rows.groupBy("text_id", "group").agg(F.min("ref").alias("ref"), F.array_sort(F.collect_list(F.struct("ref", *[f"c{i}" for i in range(n)]))).alias("x"))
    of = lambda i: F.filter("x", lambda r: r[f"c{i}"].isNotNull())
    refs = F.array(*[F.transform(of(i), lambda r: r["ref"]).cast(f"array<{kind}>") for i in range(n)])
    words = lambda i: F.flatten(F.transform(of(i), lambda r: r[f"c{i}"]["s"]))
    segments = F.array(*[words(i) for i in range(n)])
    return got.select("text_id", "ref", refs.alias("refs"), segments.alias("segments"))


def attach_alignments(parallel: DataFrame, alignments: DataFrame) -> DataFrame:
    """parallel with pairs of the alignment row of the same reference, if both sides have words."""
    rows = parallel.join(alignments.select("text_id", "ref", F.col("pairs").alias("__pairs")), ["text_id", "ref"], "left")
    full = (F.size("source_segment") > 0) & (F.size("target_segment") > 0)
    return rows.withColumn("pairs", F.when(full, F.col("__pairs"))).drop("__pairs")


def merge_duplicates(corpus: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row for each reference; words of rows with equal references put together in order."""
    return corpus.groupBy("text_id", "ref").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("segment").alias("seg")))), lambda x: x["seg"])).alias("segment"))
