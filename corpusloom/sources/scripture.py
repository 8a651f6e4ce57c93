"""Verses out of marked-up scripture texts, USFM and USX, with Spark's expressions and windows.

A file is cut at its markers, one row each. Chapter, verse and paragraph of a row are the last ones
before it in the file, and notes are what lies between their marks: windows over a file's rows, so a
file (one book) is the unit, and files are worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_sentence_ending

#: Paragraph markers that hold verse text, and those that don't; a digit may follow. Fixed values.
VERSE_PARAGRAPHS = "p m po pr cls pmo pm pmc pmr pi mi nb pc b q qr qc qm qd lh li lf lim ph tr".split()
OTHER_PARAGRAPHS = "id ide usfm sts rem h toc toca mt mte imt is ip ipi im imi ipq ib iot io ie s sr sd ms mr r d sp qa cl cp cd lit restore".split()
#: Notes and figures: their text is no verse text. Fixed values.
NOTES = "f fe ef x ex fig rq".split()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, content) of each file; text_id is its name without ending."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("text_id"), F.col("value").alias("content"))


def _kind(marker: Column) -> Column:
    base = F.regexp_replace(marker, r"\d+$", "")
    return F.when(base.isin(VERSE_PARAGRAPHS), "verse").when(base.isin(OTHER_PARAGRAPHS), "other")


def usfm_tokens(files: DataFrame) -> DataFrame:
    """(text_id, at, marker, closes, argument, text) of files (text_id, content); text before any marker has none."""
    parts = files.select("text_id", F.posexplode(F.split("content", r"(?=\\)")).alias("at", "part"))
    head = r"^\\\+?([A-Za-z][A-Za-z0-9-]*)(\*?)"
    marker = F.regexp_extract("part", head, 1)
    rest = F.regexp_replace("part", r"^\\\+?[A-Za-z][A-Za-z0-9-]*(?:\*|[ \t]?)", "")
    closes = F.regexp_extract("part", head, 2) == "*"
    takes = marker.isin("c", "v", "id", *NOTES[:5]) & ~closes
    argument = F.when(takes, F.regexp_extract(rest, r"^\s*(\S+)", 1)).otherwise("")
    text = F.when(takes, F.regexp_replace(rest, r"^\s*\S+[ \t]?", "")).otherwise(rest)
    text = F.regexp_replace(text, r"\|[^\n]*$", "")  # attributes of a word, link or figure
    return parts.select("text_id", "at", marker.alias("marker"), closes.alias("closes"), argument.alias("argument"), text.alias("text"))


def usx_tokens(files: DataFrame) -> DataFrame:
    """The same of USX files: their elements take the names of USFM markers."""
    parts = files.select("text_id", F.posexplode(F.split("content", "(?=<)")).alias("at", "part"))
    tag, closes = F.regexp_extract("part", r"^</?([A-Za-z]+)", 1), F.col("part").startswith("</")
    attribute = lambda name: F.regexp_extract("part", rf'^<[^>]*?\b{name}="([^"]*)"', 1)
    marker = (
        F.when(tag.isin("chapter", "verse"), F.when(attribute("number") != "", F.substring(tag, 1, 1)).when(tag == "verse", "v").otherwise(""))
        .when(tag == "book", F.when(closes, "").otherwise("id"))
        .when(tag == "para", F.when(closes, "").otherwise(attribute("style")))
        .when(tag == "note", "f")
        .when(tag == "figure", "fig")
        .otherwise("")
    )
    argument = F.when(tag == "book", attribute("code")).otherwise(attribute("number"))
    text = F.regexp_replace("part", "^<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.regexp_replace(text, f"&{name};", char)
    return parts.select("text_id", "at", marker.alias("marker"), closes.alias("closes"), argument.alias("argument"), F.when(tag == "book", "").otherwise(text).alias("text"))


def verse_rows(tokens: DataFrame) -> DataFrame:
    """(text_id, book, chapter, verse, text, sentence_start, seq), one row for each verse of each file.

    Headings, notes and figures are left out; white space is one space. A verse starts a sentence unless
    the verse before it in the file ends without a sentence ending. A verse marked twice in a chapter is
    one row. Verses without text are rows too; files without verses give none.
    """
    before = Window.partitionBy("text_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    note = F.col("marker").isin(NOTES)
    depth = F.sum(F.when(note & ~F.col("closes"), 1).when(note, -1).otherwise(0)).over(before)
    # A paragraph, chapter or verse ends what was left open.
    kind = F.last(F.when(F.col("marker").isin("c", "id"), "other").when(F.col("marker") == "v", "verse").otherwise(_kind(F.col("marker"))), ignorenulls=True).over(before)
    rows = tokens.select(
        "*",
        F.last(F.when(F.col("marker") == "id", F.col("argument")), ignorenulls=True).over(before).alias("book"),
        F.last(F.when(F.col("marker") == "c", F.col("argument")), ignorenulls=True).over(before).alias("chapter"),
        F.last(F.when(F.col("marker").isin("c", "id"), "").when(F.col("marker") == "v", F.col("argument")), ignorenulls=True).over(before).alias("verse"),
        kind.alias("kind"),
        ((depth > 0) | note & ~F.col("closes")).alias("in_note"),
    )
    kept = rows.where("verse <> ''").withColumn("text", F.when((F.col("kind") == "verse") & ~F.col("in_note"), F.col("text")).otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    verses = kept.groupBy("text_id", "book", "chapter", "verse").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.min("at").alias("seq"))
    order = Window.partitionBy("text_id").orderBy("seq")
    starts = F.coalesce(F.lag(has_sentence_ending(F.col("text")) | (F.col("text") == "")).over(order), F.lit(True))
    return verses.select("text_id", "book", "chapter", "verse", "text", starts.alias("sentence_start"), F.col("seq").cast("bigint").alias("seq"))


def read_usfm(spark: SparkSession, path: str) -> DataFrame:
    return verse_rows(usfm_tokens(read_files(spark, path)))


def read_usx(spark: SparkSession, path: str) -> DataFrame:
    return verse_rows(usx_tokens(read_files(spark, path)))
