"""Versifications: numberings of verses, read from files, and corpora brought from one to another.

A versification says how many verses each chapter has and which of its verses are which verses of the standard
numbering; those it doesn't name have the same number there. A reference goes from one versification to another by way of the
standard one. Mappings are intervals in the files and one row a verse in the tables, so that a conversion is an equi-join
on (book, chapter, verse), evenly dealt over tasks; small tables are broadcast by their counted bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sizes import bounded
from ..storage import stash

IN_RANGE, RANGE_START, SENTENCE_START = 2, 4, 1
REF = ("book", "chapter", "verse")
_SIDE = r"([A-Z0-9]{3})\s+(\d+):(\d+)(?:-(\d+))?"


@dataclass
class Versification:
    """lengths (book, chapter, last_verse); mapped (book, chapter, verse, to_book, to_chapter, to_verse, to_last), to being the
    standard numbering and to_last differing where one verse is several there; left_out (book, chapter, verse)."""

    lengths: DataFrame
    mapped: DataFrame
    left_out: DataFrame


def _of_lines(lines: DataFrame) -> Versification:
    """Of (file, line, value): later lines replace earlier ones, chapter by chapter and verse by verse."""
    said = F.trim(F.regexp_replace(F.regexp_replace("value", r"^#!\s*", ""), r"#.*$", ""))
    lines = lines.select(F.struct("file", "line").alias("at"), said.alias("said"))
    listed = lines.where(F.col("said").rlike(r"^[A-Z0-9]{3}(\s+\d+:\d+)+$"))
    chapters = listed.select("at", F.substring("said", 1, 3).alias("book"), F.explode(F.regexp_extract_all("said", F.lit(r"(\d+:\d+)"), F.lit(1))).alias("x"))
    part = lambda i: F.split("x", ":")[i].cast("int")
    lengths = chapters.select("at", "book", part(0).alias("chapter"), part(1).alias("last_verse")).groupBy("book", "chapter").agg(F.max_by("last_verse", "at").alias("last_verse"))

    number = lambda i: F.regexp_extract("said", rf"^&?{_SIDE}\s*=\s*{_SIDE}$", i)
    whole = lambda i: number(i).cast("int")
    end = lambda i: F.when(number(i) == "", whole(i - 1)).otherwise(whole(i))
    spans = lines.where(number(1) != "").select("at", number(1).alias("book"), whole(2).alias("chapter"), whole(3).alias("first"), end(4).alias("last"), number(5).alias("to_book"), whole(6).alias("to_chapter"), whole(7).alias("to_first"), end(8).alias("to_end"))
    return Versification(lengths, _verses(spans), lines.where(F.col("said").rlike(rf"^-{_SIDE}$")).select(F.regexp_extract("said", _SIDE, 1).alias("book"), F.regexp_extract("said", _SIDE, 2).cast("int").alias("chapter"), F.regexp_extract("said", _SIDE, 3).cast("int").alias("verse")).distinct())


def _verses(spans: DataFrame) -> DataFrame:
    """One row for each verse of intervals (at, book, chapter, first, last, to_book, to_chapter, to_first, to_end).

    Intervals of one length go verse by verse. Of others, each verse is all of the other side: many verses
    are one, or one is many. Of intervals that overlap the later one holds.
    """
    even = F.col("last") - F.col("first") == F.col("to_end") - F.col("to_first")
    each = spans.select("*", F.explode(F.sequence("first", "last")).alias("verse"))
    to = F.struct("to_book", "to_chapter", F.when(even, F.col("to_first") + F.col("verse") - F.col("first")).otherwise(F.col("to_first")).alias("to_verse"), F.when(even, F.col("to_first") + F.col("verse") - F.col("first")).otherwise(F.col("to_end")).alias("to_last"))
    return each.groupBy(*REF).agg(F.max_by(to, "at").alias("to")).select(*REF, "to.*")


def read_versification(spark: SparkSession, *paths: str) -> Versification:
    """The versification of files; a later file, such as a project's own, adds to and replaces what the ones before say.

    Lines are: chapters with their last verses (GEN 1:31 2:25), mappings to the standard numbering (GEN 31:55 = GEN 32:1, also
    of ranges, and with & many to one), verses left out (-MAT 17:21); # begins a comment, #! a line for newer readers.
    """
    out = None
    for i, path in enumerate(paths):
        lines = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
        out = lines if out is None else out.unionByName(lines)
    return _of_lines(out)


def mapped(spans: DataFrame) -> DataFrame:
    """The table `mapped` of a Versification, from intervals (book, chapter, first, last, to_book, to_chapter, to_first, to_end)."""
    return _verses(spans.withColumn("at", F.lit(0)))


def reverse(table: DataFrame) -> DataFrame:
    """From the standard numbering back: verses that were brought together are a range again; a range leads to its one verse."""
    spread = table.select("*", F.explode(F.sequence("to_verse", "to_last")).alias("at"))
    back = spread.groupBy(F.col("to_book").alias("b"), F.col("to_chapter").alias("c"), F.col("at").alias("v")).agg(F.min(F.struct("book", "chapter", "verse")).alias("first"), F.collect_set(F.struct("book", "chapter", "verse")).alias("all"))
    last = F.array_max(F.transform(F.filter("all", lambda x: (x["book"] == F.col("first.book")) & (x["chapter"] == F.col("first.chapter"))), lambda x: x["verse"]))
    return back.select(F.col("b").alias("book"), F.col("c").alias("chapter"), F.col("v").alias("verse"), F.col("first.book").alias("to_book"), F.col("first.chapter").alias("to_chapter"), F.col("first.verse").alias("to_verse"), last.alias("to_last"))


def _step(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their reference, and the last verse of it, taken through a table."""
    table = bounded(table)
    at = lambda verse, prefix: [F.col(f"{prefix}{c}") == F.col(r) for c, r in (("book", "ref_book"), ("chapter", "ref_chapter"), ("verse", verse))]
    named = lambda prefix, *columns: table.select(*[F.col(c).alias(prefix + c) for c in (*REF, *columns)])
    out = rows.join(named("__a_", "to_book", "to_chapter", "to_verse"), at("ref_verse", "__a_"), "left").join(named("__z_", "to_last"), at("ref_last", "__z_"), "left")
    to = lambda new, old: F.coalesce(new, old).alias(old)
    rest = [c for c in rows.columns if not c.startswith("ref_")]
    verse = F.coalesce("__a_to_verse", "ref_verse")
    return out.select(*rest, to("__a_to_book", "ref_book"), to("__a_to_chapter", "ref_chapter"), verse.alias("ref_verse"), F.greatest(verse, F.coalesce("__z_to_last", F.when(F.col("ref_last") > F.col("ref_verse"), F.col("ref_last")).otherwise(verse))).alias("ref_last"))


def convert(corpus: DataFrame, source: DataFrame | None, target: DataFrame | None) -> DataFrame:
    """corpus (book, chapter, verse and more) with ref_book, ref_chapter, ref_verse, ref_last: its references in another versification.

    source and target are tables `mapped`, None standing for the standard numbering. Of a verse that is several in the
    other numbering, ref_verse to ref_last are all (of one chapter). References that no table names stay as they are, null ones too.
    """
    rows = corpus.withColumns({"ref_book": F.col("book"), "ref_chapter": F.col("chapter"), "ref_verse": F.col("verse"), "ref_last": F.col("verse")})
    if source is not None:
        rows = _step(rows, stash(source, "mapped"))
    return rows if target is None else _step(rows, stash(reverse(target), "reversed"))


def _lead(flags: str) -> Column:
    """Flags of a range's first row: it opens the range, unless the row already was within one."""
    within = (F.col(flags).bitwiseAND(IN_RANGE) > 0) & (F.col(flags).bitwiseAND(RANGE_START) == 0)
    return F.lit(IN_RANGE) + F.col(flags).bitwiseAND(SENTENCE_START) + F.when(within, 0).otherwise(RANGE_START)


def with_ranges(converted: DataFrame, order: list[str], text: str = "text_id") -> DataFrame:
    """convert()'s rows (with segment and flags), rows that have come to one reference being a range.

    The first of them, in the given order, gets the words of all, the others are empty; a row that has become several verses is a row
    for each, the first with its words. Result: (text_id, ref_book, ref_chapter, ref_verse, book, chapter, verse, place, segment, flags),
    place numbering the rows of a reference. Flags add up as in operators.joins. What is gathered is the rows of one reference of one text.
    """
    ref, none = ["ref_book", "ref_chapter", "ref_verse"], F.array().cast("array<string>")
    many = F.col("ref_last") > F.col("first")
    rows = converted.select(F.col(text).alias("text_id"), *ref[:2], F.col("ref_verse").alias("first"), "ref_last", F.struct(*order).alias("o"), "book", "chapter", "verse", F.coalesce("segment", none).alias("segment"), F.coalesce("flags", F.lit(SENTENCE_START)).alias("flags"))
    rows = rows.withColumn("ref_verse", F.explode(F.when(many, F.sequence("first", "ref_last")).otherwise(F.array("first"))))
    rows = rows.withColumns({"segment": F.when(F.col("ref_verse") > F.col("first"), none).otherwise(F.col("segment")), "flags": F.when(F.col("ref_verse") > F.col("first"), F.lit(IN_RANGE)).when(many, _lead("flags")).otherwise(F.col("flags"))})
    got = rows.groupBy("text_id", *ref).agg(F.array_sort(F.collect_list(F.struct("o", "book", "chapter", "verse", "segment", "flags"))).alias("x"))
    got = got.select("text_id", *ref, F.flatten(F.transform("x", lambda r: r["segment"])).alias("words"), F.size("x").alias("n"), F.posexplode("x").alias("place", "r"))
    flags = F.when(F.col("n") == 1, F.col("r.flags")).when(F.col("place") == 0, _lead("r.flags")).otherwise(F.lit(IN_RANGE))
    return got.select("text_id", *ref, "r.book", "r.chapter", "r.verse", "place", F.when(F.col("place") == 0, F.col("words")).otherwise(none).alias("segment"), flags.cast("int").alias("flags"))


def missing(lengths: DataFrame, rows: DataFrame) -> DataFrame:
    """(book, chapter, verse, problem) of rows against a versification's lengths: missing verses, and those of no chapter (extra).

    rows are (book, chapter, verse) of single verses; nulls are extra.
    """
    wanted = lengths.where("last_verse >= 1").select("book", "chapter", F.explode(F.sequence(F.lit(1), "last_verse")).alias("verse"))
    found = rows.select(*REF).distinct()
    lost = wanted.join(found, list(REF), "left_anti").withColumn("problem", F.lit("missing"))
    return lost.unionByName(found.join(wanted, list(REF), "left_anti").withColumn("problem", F.lit("extra")))
