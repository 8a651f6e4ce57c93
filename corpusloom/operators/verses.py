"""Verse references: canonical verses, ranges of verses and of chapters, extraction by reference."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Books in canonical order, the old testament's 39 first. Fixed values.
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV"
).split()
OLD, NEW = BOOKS[:39], BOOKS[39:]
RANGE = "<range>"


def verse_refs(lengths: DataFrame) -> DataFrame:
    """(book, chapter, verse) of all canonical verses, lengths being (book, chapter, last_verse)."""
    return lengths.where("last_verse >= 1").select("book", "chapter", F.explode(F.sequence(F.lit(1), F.col("last_verse").cast("int"))).alias("verse"))


def verse_numbers(verse: Column) -> Column:
    """Array of structs (num, part) of a reference as 1-3,5a."""
    bound = lambda s: F.struct(F.regexp_extract(s, r"^\s*(\d+)", 1).cast("int").alias("num"), F.regexp_extract(s, r"^\s*\d+\s*(\S*)", 1).alias("part"))

    def span(s: Column) -> Column:
        first, last = bound(F.split_part(s, F.lit("-"), F.lit(1))), bound(F.regexp_extract(s, r"([^-]*)$", 1))
        between = F.transform(F.sequence(first["num"] + 1, F.greatest(last["num"] - 1, first["num"] + 1)), lambda n: F.struct(n.alias("num"), F.lit("").alias("part")))
        between = F.filter(between, lambda x: x["num"] < last["num"])
        return F.when(s.contains("-"), F.concat(F.array(first), between, F.array(last))).otherwise(F.array(first))

    pieces = F.filter(F.split(verse, ","), lambda s: s.rlike(r"^\s*\d+[^-]*(-\s*\d+.*)?$"))
    return F.array_distinct(F.flatten(F.transform(pieces, span)))


def merge_verse_ranges(rows: DataFrame, *key: str) -> DataFrame:
    """(key, verse): all verses of a key's references (column verse) as the shortest list of ranges.

    A part of a verse (5a) goes if the whole verse is there. Parts of one verse are ranges of their own.
    """
    nums = rows.select(*key, F.explode(verse_numbers(F.col("verse"))).alias("v")).select(*key, "v.num", "v.part").distinct()
    whole = nums.withColumn("whole", F.max(F.col("part") == "").over(Window.partitionBy(*key, "num")))
    nums = whole.where("part = '' or not whole").drop("whole")
    order = Window.partitionBy(*key).orderBy("num", "part")
    islands = nums.withColumn("opens", (~F.lag("num").over(order).eqNullSafe(F.col("num") - 1)).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.concat(F.col("num").cast("string"), F.col("part"))
    spans = islands.groupBy(*key, "island").agg(F.min_by(name, F.struct("num", "part")).alias("a"), F.max_by(name, F.struct("num", "part")).alias("b"))
    spans = spans.withColumn("span", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("-", "a", "b")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "span"))), lambda x: x["span"]), ",")
    return spans.groupBy(*key).agg(listed.alias("verse"))


def extract(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """(book, chapter, verse, text) for each of refs, from rows (book, chapter, verse as text, text).

    A row over several verses has its text at the first and <range> at the others. Rows of one verse
    are put together in their order (seq); a verse without rows has an empty text.
    """
    nums = F.transform(verse_numbers(F.col("verse")), lambda v: v["num"])
    spread = rows.select("book", F.col("chapter").cast("int").alias("chapter"), "seq", "text", F.posexplode(F.array_distinct(nums)).alias("at", "verse"))
    texts = F.array_sort(F.collect_list(F.when((F.col("at") == 0) & (F.col("text") != ""), F.struct("seq", "text"))))
    found = spread.groupBy("book", "chapter", "verse").agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("own"), F.max(F.col("at") > 0).alias("inside"))
    text = F.when(F.coalesce(F.length("own"), F.lit(0)) > 0, F.col("own")).when(F.col("inside"), RANGE).otherwise("")
    return refs.join(found, ["book", "chapter", "verse"], "left").select("book", "chapter", "verse", text.alias("text"))


def chapters(selection: str, lengths: Mapping[str, int]) -> dict[str, list[int]]:
    """Books and chapters of a selection as GEN-EXO;MAT1-3,5;-MRK4, an empty list being the whole book.

    lengths has the number of chapters by book. Selections are parted by semicolons, plain books by commas
    too; OT and NT are all their books; what begins with - is taken away again.
    """
    place = {b: i for i, b in enumerate(BOOKS)}
    chosen: dict[str, set[int]] = {}

    def named(book: str) -> str:
        if book not in lengths:
            raise ValueError(f"{book} is no book")
        return book

    def expand(part: str) -> dict[str, set[int]]:
        if part in ("OT", "NT"):
            return {b: set(range(1, lengths[b] + 1)) for b in (OLD if part == "OT" else NEW) if b in lengths}
        if m := re.fullmatch(r"([A-Z\d]{3})-([A-Z\d]{3})", part):
            a, b = place[named(m[1])], place[named(m[2])]
            if a >= b:
                raise ValueError(f"{part} is no range of books")
            return {x: set(range(1, lengths[x] + 1)) for x in BOOKS[a : b + 1] if x in lengths}
        book, some = named(part[:3]), part[3:].strip()
        if not some:
            return {book: set(range(1, lengths[book] + 1))}
        got: set[int] = set()
        for piece in some.split(","):
            m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", piece)
            first, last = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
            if not m or first == 0 and m[2] or last > lengths[book] or m[2] and last <= first:
                raise ValueError(f"{piece} isn't in {book}")
            got |= set(range(first, last + 1))
        return {book: got}

    books = re.fullmatch(r"([A-Z\d]{3}|OT|NT)(, ?([A-Z\d]{3}|OT|NT))*", selection.strip())
    for part in filter(None, (p.strip() for p in selection.strip().split("," if books else ";"))):
        for book, some in expand(part.removeprefix("-")).items():
            if not part.startswith("-"):
                chosen.setdefault(book, set()).update(some)
            elif book not in chosen or not some <= chosen[book]:
                raise ValueError(f"{part} takes away what isn't there")
            else:
                chosen[book] -= some
    return {b: [] if len(c) == lengths[b] else sorted(c) for b, c in chosen.items() if c}
