"""Readers and writers of corpus text files, through Spark's own file sources.

A corpus file has a row a line: keys, text and flags between tabs; or just the text, whose reference is
then the line's number. Keys are parts between underscores. Flags are names or their short forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import IN_RANGE, RANGE_START, SENTENCE_START
from ..storage import stash

#: Names of flags and their short forms. Fixed values.
FLAGS = {"sentence_start": SENTENCE_START, "ss": SENTENCE_START, "in_range": IN_RANGE, "ir": IN_RANGE, "range_start": RANGE_START | IN_RANGE, "rs": RANGE_START | IN_RANGE}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their numbers from 1, in each file.

    Files are read whole, one row each, since a line's number depends on all lines before it; many files
    are read side by side.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = F.split("value", "\r\n|\n|\r", -1)
    files = files.withColumn("lines", F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines))
    return files.select("file", F.posexplode("lines").alias("at", "value")).select("file", (F.col("at") + 1).alias("line"), "value")


def flag_bits(names: Column) -> Column:
    """Flags of a comma-separated list, put together."""
    bits = F.transform(F.split(F.lower(names), ","), lambda x: F.coalesce(*[F.when(F.trim(x) == k, F.lit(v)) for k, v in FLAGS.items()], F.lit(0)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s.bitwiseOR(x))


def read_corpus(spark: SparkSession, path: str, text_id: str | None = None, pattern: str | None = None) -> DataFrame:
    """(text_id, ref, segment, flags) of one or more files; text_id is given, what a pattern's stars stand for in
    the file's name, or that name without its ending.

    ref is an array of keys. Lines of three columns have flags; others start a sentence.
    """
    rows = numbered_lines(spark, path).withColumn("p", F.split("value", "\t", -1))
    three, one = F.size("p") == 3, F.size("p") == 1
    text = F.when(one, F.col("p")[0]).otherwise(F.col("p")[1])
    text = F.trim(text)
    return rows.select(
        F.lit(text_id).alias("text_id") if text_id else corpus_id(F.col("file"), pattern).alias("text_id") if pattern else F.regexp_replace("file", r"\.[^.]*$", "").alias("text_id"),
        F.when(one, F.array(F.col("line").cast("string"))).otherwise(F.split(F.col("p")[0], "_")).alias("ref"),
        F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text)).alias("segment"),
        F.when(three, flag_bits(F.element_at("p", 3))).otherwise(F.lit(SENTENCE_START)).alias("flags"),
        F.col("line").cast("bigint").alias("seq"),
    )


def corpus_id(path: Column, pattern: str) -> Column:
    """A file's text id by a pattern with stars: what they stand for, joined by hyphens."""
    import re

    regex = ".*" + "(.*?)".join(re.escape(p) for p in pattern.split("*")) + "$"
    parts = pattern.count("*")
    return F.concat_ws("-", *[F.regexp_extract(path, regex, i + 1) for i in range(parts)]) if parts else F.lit("*all*")


def read_alignments(spark: SparkSession, path: str, scores: bool = False) -> DataFrame:
    """(ref, pairs) of a file of pairs such as 0-1 2-NULL:0.5, with a key and a tab before them or not; with scores on demand."""
    from ..operators.word_alignment import from_pharaoh, from_pharaoh_scored

    rows = numbered_lines(spark, path).withColumn("p", F.split("value", "\t", 2))
    keyed = F.size("p") == 2
    return rows.select("file", F.when(keyed, F.split(F.col("p")[0], "[-_]")).otherwise(F.array(F.col("line").cast("string"))).alias("ref"), (from_pharaoh_scored if scores else from_pharaoh)(F.element_at("p", -1)).alias("pairs"))


def read_giza(spark: SparkSession, path: str) -> DataFrame:
    """(n, source, target, pairs) of blocks of three lines: a comment, a sentence, and words with ({ 1 2 })."""
    rows = numbered_lines(spark, path).withColumn("n", F.floor((F.col("line") - 1) / 3)).withColumn("k", F.pmod(F.col("line") - 1, F.lit(3)))
    rows = rows.groupBy("file", "n").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("second"))
    words = F.regexp_extract_all("second", F.lit(r"(\S+) \(\{[0-9 ]*\}\)"), F.lit(1))
    lists = F.regexp_extract_all("second", F.lit(r"\S+ \(\{([0-9 ]*)\}\)"), F.lit(1))
    rows = rows.withColumn("words", words).withColumn("lists", lists)
    numbers = lambda x: F.transform(F.filter(F.split(x, " "), lambda t: t != ""), lambda t: t.cast("int") - 1)
    pairs = F.flatten(F.transform("lists", lambda x, i: F.transform(numbers(x), lambda j: F.struct((i - 1).cast("int").alias("i"), j.alias("j")))))
    return rows.select("n", F.slice("words", F.lit(2), F.size("words")).alias("source"), F.filter(F.split("first", " "), lambda t: t != "").alias("target"), F.filter(pairs, lambda p: p["i"] >= 0).alias("pairs"))


def write_parallel(parallel: DataFrame, path: str) -> None:
    """Three folders of aligned lines in reference order: source, target and references.

    A side that is within a range (sflags, tflags, where there are such columns) but not at its start, and so has no words of
    its own, is <range>. The rows are put in order once, in a table of their own, and each folder's files are written
    from it part by part, so that lines of the three agree, also where references are equal.
    """

    def text(segment: str, flags: str):
        words = F.array_join(segment, " ")
        if flags not in parallel.columns:
            return F.when(F.size(segment) > 0, words).otherwise("")
        inside = (F.col(flags).bitwiseAND(2) > 0) & (F.col(flags).bitwiseAND(4) == 0)
        return F.when(F.size(segment) > 0, words).when(inside, "<range>").otherwise("")

    rows = parallel.select("text_id", "ref", text("source_segment", "sflags").alias("source"), text("target_segment", "tflags").alias("target"))
    rows = stash(rows.orderBy("text_id", "ref", "source", "target"), "aligned-lines").orderBy("text_id", "ref", "source", "target")
    rows.select("source").write.text(f"{path}/source")
    rows.select("target").write.text(f"{path}/target")
    rows.select(F.concat_ws(" ", F.col("text_id").cast("string"), F.col("ref").cast("string"))).write.text(f"{path}/refs")


def write_lexicon(table: DataFrame, path: str) -> None:
    """A lexicon as lines of source word, target word and probability between tabs, likeliest first."""
    table.orderBy("src", F.desc("prob"), "trg").select("src", "trg", "prob").write.csv(path, sep="\t")


def write_tokens(corpus: DataFrame, path: str) -> None:
    """Tokens with spaces between, a row a line, in order."""
    corpus.orderBy("text_id", "ref").select(F.concat_ws(" ", "segment")).write.text(path)
