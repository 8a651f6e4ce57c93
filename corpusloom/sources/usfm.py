"""Marked-up scripture by stylesheet: nested character styles, notes, sidebars, tables, text that is no verse.

Files are read by lines, in the blocks that Spark deals them in, so a book isn't one task's string. Chapters close all that is
open in them; a chapter is therefore read without those before it, and chapters of one book are read side by side. Which
chapter a line is in is told by counts of chapter markers, within each block and summed up over blocks. In a chapter
markers pass one by one through an object that holds what is open (Openings); it never holds a chapter's text.

What a marker is (paragraph, character style, note) and whether its paragraph is verse text comes from a table of
styles, read from a file of `\\Marker` entries. A marker that isn't there is a paragraph at the beginning of a line, and a character style elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_sentence_ending
from ..operators.verses import verse_numbers

#: Flags of a row, added up: see operators.joins.
SENTENCE_START, IN_RANGE, RANGE_START = 1, 2, 4

_STYLES = "marker string, kind string, text_type string, end_marker string"
_PARSED = "text_id string, section int, at bigint, book string, chapter string, verse string, verse_no int, kind string, path string, styles array<string>, unmatched boolean, text string, raw string"


def read_stylesheet(spark: SparkSession, *paths: str) -> DataFrame:
    """(marker, kind, text_type, end_marker), in lower case, of stylesheet files.

    A marker's later entry replaces its earlier ones, the files in the given order; an entry `\\Marker name -` removes it.
    """
    out = None
    for number, path in enumerate(paths):
        entries = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"(?i)\n\s*\\Marker[ \t]+")).alias("place", "entry")).where("place > 0")
        field = lambda name: F.lower(F.trim(F.regexp_extract("entry", rf"(?i)\n\s*\\{name}[ \t]+([^\r\n#]*)", 1)))
        head = F.split(F.trim(F.regexp_extract("entry", r"^([^\r\n#]*)", 1)), r"\s+")
        rows = entries.select(F.lit(number).alias("file"), "place", head[0].alias("marker"), F.coalesce(F.get(head, F.lit(1)) == "-", F.lit(False)).alias("gone"), field("StyleType").alias("kind"), field("TextType").alias("text_type"), field("Endmarker").alias("end_marker"))
        out = rows if out is None else out.unionByName(rows)
    last = out.groupBy("marker").agg(F.max(F.struct("file", "place", "gone", "kind", "text_type", "end_marker")).alias("x"))
    return last.where("not x.gone").select("marker", "x.kind", "x.text_type", "x.end_marker")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, block, line, value) of the lines of files; text_id is a file's name without its ending.

    A large file is read in several blocks; (block, line) is its order.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path).select(name.alias("text_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def memory_lines(texts: DataFrame) -> DataFrame:
    """The same of texts (text_id, content)."""
    return texts.select("text_id", F.lit(0).cast("bigint").alias("block"), F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line", "value")).withColumn("line", F.col("line").cast("bigint"))


_MARKER = r"^\\(\+?)([A-Za-z][A-Za-z0-9-]*)(\*?)"


def tokens(lines: DataFrame) -> DataFrame:
    """Lines cut at their markers: (text_id, block, line, pos, marker, nested, closes, text, raw); text before any marker has none.

    A marker's text has neither the white space after the marker nor attributes (from | on).
    """
    parts = lines.select("text_id", "block", "line", F.posexplode(F.split("value", r"(?=\\[+A-Za-z])")).alias("pos", "raw")).where("raw <> '' or pos = 0")
    rest = F.regexp_replace("raw", r"^\\\+?[A-Za-z][A-Za-z0-9-]*(?:\*|[ \t]?)", "")
    return parts.select(
        "text_id", "block", "line", "pos",
        F.regexp_extract("raw", _MARKER, 2).alias("marker"),
        (F.regexp_extract("raw", _MARKER, 1) == "+").alias("nested"),
        (F.regexp_extract("raw", _MARKER, 3) == "*").alias("closes"),
        F.regexp_replace(rest, r"\|.*$", "").alias("text"),
        "raw",
    )


def sections(rows: DataFrame) -> DataFrame:
    """Tokens with section, the number of book and chapter markers up to each in its text, and book, the code of the text's first book marker."""
    starts = (F.col("marker").isin("c", "id") & ~F.col("closes")).cast("int")
    rows = rows.withColumn("starts", starts)
    blocks = rows.groupBy("text_id", "block").agg(F.sum("starts").alias("n"), F.min(F.when(F.col("marker") == "id", F.struct("line", "pos", F.upper(F.regexp_extract("text", r"^\s*(\S{1,3})", 1)).alias("book")))).alias("id"))
    order = Window.partitionBy("text_id").orderBy("block")  # one row for each block of a file
    blocks = blocks.select("text_id", "block", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.first("id.book", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("book"))
    within = F.sum("starts").over(Window.partitionBy("text_id", "block").orderBy("line", "pos"))
    numbered = rows.withColumn("within", within).join(blocks, ["text_id", "block"])
    return numbered.withColumn("section", (F.col("before") + F.col("within")).cast("int")).drop("starts", "within", "before")


class Openings:
    """What is open at a place of a chapter. One call of step for each token; what it gives are rows of the output."""

    def __init__(self, styles: dict[str, tuple[str, str]], book: str | None):
        self.styles, self.book = styles, book or ""
        self.chapter, self.verse, self.verse_no, self.repeated = "", "0", 0, False
        self.paragraph: tuple[str, str] | None = None  # marker and text type
        self.blocks: list[tuple[int, str]] = []  # sidebar, row, cell or paragraph that is no verse text: number and marker
        self.counts = [0]  # blocks and notes so far at each level
        self.waiting = False  # a verse paragraph before the first verse, without any text yet
        self.note: str | None = None
        self.chars: list[str] = []  # open character styles, outermost first
        self.below: list[str] = []  # those that were open when the note began
        self.unmatched = self.own = False  # own: the marker begins a verse or block, and so isn't part of its text

    def kind_of(self, marker: str, first: bool) -> tuple[str, str]:
        style = self.styles.get(marker) or self.styles.get(marker.split("-")[0])
        if marker in ("id", "c", "v"):
            return marker, ""
        if marker in ("esb", "esbe", "tr"):
            return marker, "other"
        if marker[:2] in ("tc", "th") and marker[2:].strip("rc0123456789-") == "":
            return "cell", ""
        if style and style[0] in ("paragraph", "character", "note", "milestone"):
            return style
        return ("paragraph", "other") if first and not self.note else ("character", "")

    def open_block(self, marker: str) -> None:
        self.counts[-1] += 1
        self.blocks.append((self.counts[-1], marker))
        self.counts.append(0)

    def close_blocks(self, keep: int) -> None:
        del self.blocks[keep:], self.counts[keep + 1 :]

    def close_inline(self) -> None:
        self.note, self.chars, self.below = None, [], []

    def in_sidebar(self) -> int:
        """How many of the open blocks are sidebars, which paragraphs don't close."""
        return sum(1 for _, m in self.blocks if m == "esb")

    def end_paragraph(self) -> Iterator[tuple[str, str]]:
        """Close paragraph, rows and cells; a verse paragraph before the first verse that had no text is an empty row."""
        self.close_inline()
        if self.waiting:
            self.open_block(self.paragraph[0])
            yield "text", self.path()
        self.waiting = False
        self.close_blocks(self.in_sidebar())
        self.paragraph = None

    def path(self, *more: tuple[int, str]) -> str:
        return "/".join(f"{n}:{m}" for n, m in [*self.blocks, *more])

    def new_verse(self, number: str) -> None:
        """A verse of its own; one that repeats the current number is left out; overlapping ranges become one."""
        a, b = _span(number), _span(self.verse)
        if number == self.verse and number != "0":
            self.repeated = True
            return
        self.repeated = False
        if self.verse_no and a and b and a[0] <= b[1] and b[0] <= a[1] and not (number[-1:].isalpha() or self.verse[-1:].isalpha()):
            self.verse = f"{min(a[0], b[0])}-{max(a[1], b[1])}"
            return
        self.verse, self.verse_no = number, self.verse_no + 1
        self.counts, self.blocks = [0], []

    def step(self, marker: str, nested: bool, closes: bool, text: str, first: bool) -> Iterator[tuple[str, str, str]]:
        """(kind, path, text) of each output row: kind is verse, text or note, empty for what belongs to no row."""
        self.unmatched = self.own = False
        if closes:
            self.close(marker, nested)
        elif marker:
            kind, text_type = self.kind_of(marker, first)
            self.own = kind in ("id", "c", "v", "esb", "esbe") or self.verse == "0" and kind in ("tr", "cell") or kind == "paragraph" and (text_type != "versetext" or self.verse == "0" or self.in_sidebar() > 0)
            if kind in ("id", "c"):
                yield from ((k, p, "") for k, p in self.end_paragraph())
                self.close_blocks(0)
                head, _, text = text.lstrip().partition(" ")
                if kind == "c":
                    self.chapter, self.verse, self.verse_no, self.counts, self.repeated = head, "0", 0, [0], False
                else:
                    text = ""
            elif kind == "v":
                if self.paragraph and self.paragraph[1] not in ("versetext", ""):
                    yield from ((k, p, "") for k, p in self.end_paragraph())
                self.waiting, self.note = False, None
                head, _, text = text.lstrip().partition(" ")
                self.new_verse(head)
            elif kind in ("esb", "esbe"):
                yield from ((k, p, "") for k, p in self.end_paragraph())
                self.close_blocks(0)
                if kind == "esb":
                    self.open_block(marker)
            elif kind == "tr":
                yield from ((k, p, "") for k, p in self.end_paragraph())
                self.paragraph = (marker, "versetext" if self.verse != "0" else "other")
                if self.verse == "0":
                    self.open_block(marker)
            elif kind == "cell":
                self.close_inline()
                if self.blocks and self.blocks[-1][1][:2] in ("tc", "th"):
                    self.close_blocks(len(self.blocks) - 1)
                if self.verse == "0":
                    self.open_block(marker)
            elif kind == "paragraph":
                yield from ((k, p, "") for k, p in self.end_paragraph())
                self.paragraph = (marker, text_type)
                if marker.startswith("z"):  # private use
                    self.paragraph = (marker, "other")
                elif text_type != "versetext":
                    self.open_block(marker)
                elif self.in_sidebar():
                    self.open_block(marker)
                else:
                    self.waiting = self.verse == "0"
            elif kind == "note":
                if not self.note:
                    self.below = self.chars
                self.start_text()
                if not self.repeated:
                    self.counts[-1] += 1
                self.note, self.chars = marker, []
                text = text.lstrip().partition(" ")[2]  # the caller
            elif kind == "character":
                self.start_text()
                if not nested:
                    self.chars = []
                self.chars = [*self.chars, marker]
        if text.strip():
            self.start_text()
        yield (*self.place(), text)

    def start_text(self) -> None:
        """Text of a verse paragraph before the first verse: its paragraph becomes a block."""
        if self.waiting:
            self.open_block(self.paragraph[0])
            self.waiting = False

    def close(self, marker: str, nested: bool) -> None:
        if self.note == marker:
            self.note, self.chars, self.below = None, self.below, []
            return
        while self.chars:
            last = self.chars[-1]
            deep = len(self.chars) > 1
            self.chars = self.chars[:-1]
            if last == marker and nested == deep:
                return
        self.unmatched = self.styles.get(marker, ("",))[0] != "milestone"

    def place(self) -> tuple[str, str]:
        if self.repeated or self.paragraph and self.paragraph[0].startswith("z"):
            return "", ""
        if self.note:
            return "note", self.path((self.counts[-1], self.note))
        if self.blocks and self.blocks[-1][1] not in ("esb", "tr"):
            return "text", self.path()
        return ("verse", "") if self.verse_no and not self.blocks else ("", "")


def _span(verse: str) -> tuple[int, int] | None:
    digits = [x for x in ("".join(c if c.isdigit() else " " for c in verse)).split()]
    return (int(digits[0]), int(digits[-1])) if digits else None


def parse(rows: DataFrame, styles: DataFrame) -> DataFrame:
    """What each token of sections() is in: book, chapter, verse (as 2-3 for ranges) and the verse's number in its chapter;
    kind (verse, text that is no verse, note) and path, the numbered blocks from the verse on, as 1:tr/2:tc2; the open character
    styles, outermost first; unmatched, for end markers that close nothing; text, and raw, the token as it stands.

    Tokens before the first verse of a chapter outside of any paragraph have an empty kind, as do repeated verses
    and private-use paragraphs. Files without markers give rows without a kind. The table of styles is sent to all tasks;
    a stylesheet has some hundred entries, and one of over 10,000 is refused.
    """
    listed = styles.select("marker", "kind", "text_type").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("a stylesheet has at most 10,000 markers")
    known = {r["marker"]: (r["kind"], r["text_type"] or "") for r in listed}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = rows.select("text_id", "section", "block", "line", "pos", "book", "marker", "nested", "closes", "text", "raw")
    base = base.repartition(n, "text_id", "section").sortWithinPartitions("text_id", "section", "block", "line", "pos")
    out = rows.sparkSession.createDataFrame([], _PARSED).schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        of, at, state, blank = None, 0, None, True
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in names}
            for text_id, section, _, _, pos, book, marker, nested, closes, text, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != (text_id, section):
                    of, at, state = (text_id, section), 0, Openings(known, book)
                gap = "" if pos else "\n"
                first, blank = pos == 0 or pos == 1 and blank, not raw.strip()
                before = state.chapter, state.verse, state.verse_no
                made = list(state.step(marker, nested, closes, text, first))
                now = state.chapter, state.verse, state.verse_no
                raw = made[-1][2] if state.own else raw
                for k, (kind, path, said) in enumerate(made):
                    last = k == len(made) - 1  # the others are of blocks that this marker ends
                    row = (text_id, section, at, state.book, *(now if last else before), kind, path, list(state.chars) if last else [], state.unmatched and last, gap + said, gap + raw if last else "")
                    for c, v in zip(names, row, strict=True):
                        cols[c].append(v)
                    at += 1
            if cols["at"]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in kinds], schema=kinds)

    return base.mapInArrow(run, out)


def text_rows(parsed: DataFrame, all_text: bool = False, markers: bool = False) -> DataFrame:
    """(text_id, section, seq, book, chapter, verse, kind, path, text) of verses; with all_text of headings, tables, notes and other blocks too.

    White space is one space. With markers, texts have character styles, paragraphs, attributes and notes as they stand,
    and notes are no rows. Blocks and verses without text are rows.
    """
    rows = parsed.where("kind <> ''")
    note = F.col("kind") == "note"
    if markers:
        around = F.regexp_replace("path", r"/?\d+:[^:/]*$", "")  # a note belongs to what it stands in
        rows = rows.withColumns({"kind": F.when(note & (around == ""), "verse").when(note, "text").otherwise(F.col("kind")), "path": F.when(note, around).otherwise(F.col("path"))})
    rows = rows if all_text else rows.where("kind = 'verse'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("raw" if markers else "text").alias("t")))), lambda x: x["t"]), "")
    units = rows.groupBy("text_id", "section", "verse_no", "kind", "path").agg(F.min("at").alias("seq"), F.max_by(F.struct("book", "chapter", "verse"), "at").alias("ref"), F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))
    return units.select("text_id", "section", "seq", "ref.book", "ref.chapter", "ref.verse", "kind", "path", "text")


def flagged(rows: DataFrame) -> DataFrame:
    """Verses of text_rows, one row for each verse of a range, with flags: the first has the words, the others are empty and in range.

    A verse starts a sentence unless the verse before it in the text ends within one.
    """
    verses = rows.where("kind = 'verse'")
    order = Window.partitionBy("text_id").orderBy("section", "seq")  # one row for each verse of a book
    starts = F.coalesce(F.lag(has_sentence_ending(F.col("text")) | (F.col("text") == "")).over(order), F.lit(True))
    spread = verses.withColumn("starts", starts).withColumn("many", F.size(verse_numbers(F.col("verse"))) > 1)
    spread = spread.select("*", F.posexplode(verse_numbers(F.col("verse"))).alias("place", "v"))
    flags = F.when(F.col("starts"), SENTENCE_START).otherwise(0) + F.when(F.col("many"), IN_RANGE).otherwise(0) + F.when(F.col("many") & (F.col("place") == 0), RANGE_START).otherwise(0)
    one = F.concat(F.col("v.num").cast("string"), F.col("v.part"))
    flags = F.when(F.col("place") == 0, flags).otherwise(IN_RANGE)
    return spread.select("text_id", "section", "seq", "place", "book", "chapter", one.alias("verse"), F.when(F.col("place") == 0, F.col("text")).otherwise("").alias("text"), flags.cast("int").alias("flags"))


def read_usfm(spark: SparkSession, path: str, styles: DataFrame, all_text: bool = False, markers: bool = False) -> DataFrame:
    """text_rows of USFM files."""
    return text_rows(parse(sections(tokens(read_lines(spark, path))), styles), all_text, markers)
