"""Nested markup by stylesheet."""

import random

import pytest
from corpusloom.sources import usfm
from pyspark.sql import functions as F

SHEET = r"""
\Marker id
\StyleType Paragraph
\TextType Other
\Marker h
\StyleType Paragraph
\TextType Other
\Marker mt
\StyleType Paragraph
\TextType Title
\Marker s
\StyleType Paragraph
\TextType Section
\Marker gone
\StyleType Paragraph
\Marker p
\Name Paragraph - normal
\StyleType Paragraph
\TextType VerseText
\Marker q1
\StyleType Paragraph  # poetry
\TextType VerseText
\Marker nd
\StyleType Character
\TextType VerseText
\Endmarker nd*
\Marker pro
\StyleType Character
\Endmarker pro*
\Marker f
\StyleType Note
\TextType NoteText
\Endmarker f*
\Marker ft
\StyleType Character
\TextType NoteText
"""

BOOK = r"""\id MAT A book
\h Matthew
\mt The Book
\p An opening
\weird no such marker.
\c 1
\s One
\p
\v 1 First \nd Lord \+pro within\+pro* more\nd* end.\f + \ft A note.\f* After
\q1 line two,
\v 2-3 two and three\nd open
\p still two.
\s Between
\p
\v 4 four \f + \ft inner \nd x\nd*\f*tail\pro*.
\v 4 again
\v 5
\c 2
\p
\tr \tc1 a \tc2 b
\tr \tc1 c
\p
\v 1 one
\esb
\mt Side
\p In it.
\esbe
\p rest
\zprivate hidden
\p seen
"""


@pytest.fixture(scope="module")
def styles(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sty")
    (at / "a.sty").write_text(SHEET)
    (at / "b.sty").write_text("\\Marker gone -\n\\Marker nd\n\\StyleType Character\n\\TextType Other\n")
    return usfm.read_stylesheet(spark, str(at / "a.sty"), str(at / "b.sty"))


def parsed(spark, styles, content, text_id="A"):
    return usfm.parse(usfm.sections(usfm.tokens(usfm.memory_lines(spark.createDataFrame([(text_id, content)], "text_id string, content string")))), styles)


def units(rows):
    return [(f"{r['book']} {r['chapter']}:{r['verse']}" + ("/" + r["path"] if r["path"] else ""), r["text"]) for r in rows.orderBy("text_id", "section", "seq").collect()]


def test_stylesheet(spark, styles):
    got = {r["marker"]: (r["kind"], r["text_type"], r["end_marker"]) for r in styles.collect()}
    assert "gone" not in got and got["q1"] == ("paragraph", "versetext", "") and got["nd"] == ("character", "other", "") and got["f"] == ("note", "notetext", "f*")


def test_verses(spark, styles):
    rows = usfm.text_rows(parsed(spark, styles, BOOK))
    assert units(rows) == [
        ("MAT 1:1", "First Lord within more end. After line two,"),
        ("MAT 1:2-3", "two and threeopen still two."),
        ("MAT 1:4", "four tail."),
        ("MAT 1:5", ""),
        ("MAT 2:1", "one rest seen"),
    ]
    flags = usfm.flagged(rows).orderBy("section", "seq", "place").collect()
    assert [(r["chapter"], r["verse"], r["flags"]) for r in flags] == [("1", "1", 1), ("1", "2", 6), ("1", "3", 2), ("1", "4", 1), ("1", "5", 1), ("2", "1", 1)]
    assert flags[2]["text"] == ""


def test_all_text(spark, styles):
    got = units(usfm.text_rows(parsed(spark, styles, BOOK), all_text=True))
    assert got[:6] == [("MAT :0/1:h", "Matthew"), ("MAT :0/2:mt", "The Book"), ("MAT :0/3:p", "An opening"), ("MAT :0/4:weird", "no such marker."), ("MAT 1:0/1:s", "One"), ("MAT 1:1", "First Lord within more end. After line two,")]
    assert ("MAT 1:1/1:f", "A note.") in got and ("MAT 1:2-3/1:s", "Between") in got and ("MAT 1:4/1:f", "inner x") in got
    assert [g for g in got if g[0].startswith("MAT 2:0")] == [("MAT 2:0/1:p", ""), ("MAT 2:0/2:tr/1:tc1", "a"), ("MAT 2:0/2:tr/2:tc2", "b"), ("MAT 2:0/3:tr/1:tc1", "c")]
    assert ("MAT 2:1/1:esb/1:mt", "Side") in got and ("MAT 2:1/1:esb/2:p", "In it.") in got
    assert not any("hidden" in t or "again" in t for _, t in got)


def test_markers(spark, styles):
    got = dict(units(usfm.text_rows(parsed(spark, styles, BOOK), markers=True)))
    assert got["MAT 1:1"] == r"First \nd Lord \+pro within\+pro* more\nd* end.\f + \ft A note.\f* After \q1 line two,"
    assert got["MAT 1:2-3"] == r"two and three\nd open \p still two. \p" and got["MAT 1:5"] == ""
    assert dict(units(usfm.text_rows(parsed(spark, styles, r"\id MAT" + "\n\\c 1\n\\s A \\nd b\\nd*\n\\p\n\\v 1 x"), all_text=True, markers=True)))["MAT 1:0/1:s"] == r"A \nd b\nd*"


def test_nested_styles_and_unmatched_ends(spark, styles):
    rows = parsed(spark, styles, BOOK).orderBy("section", "at").collect()
    inner = {r["text"].strip(): r["styles"] for r in rows if r["text"].strip()}
    assert inner["Lord"] == ["nd"] and inner["within"] == ["nd", "pro"] and inner["more"] == ["nd"] and inner["end."] == [] and inner["A note."] == ["ft"] and inner["x"] == ["nd"]
    assert inner["still two."] == []  # a paragraph closes what is open
    assert [r["raw"].strip() for r in rows if r["unmatched"]] == [r"\pro*."]
    overlap = dict(units(usfm.text_rows(parsed(spark, styles, "\\id MAT\n\\c 1\n\\p\n\\v 1-2 a\n\\v 2-3 b\n\\v 4 c"))))
    assert overlap == {"MAT 1:1-3": "a b", "MAT 1:4": "c"}


def test_large_book_in_blocks_equals_one_block(spark, styles, tmp_path):
    r = random.Random(3)
    lines = ["\\id GEN", "\\mt Title"]
    for c in range(1, 40):
        lines += [f"\\c {c}", r.choice(["\\s Head", "\\p Text before", "\\p"]), "\\p"]
        for v in range(1, r.randint(2, 40)):
            lines.append(f"\\v {v} " + r.choice(["plain words", "a \\nd b\\nd* c", "x\\f + \\ft note\\f*", "one\n\\q1 two\n\\s s", ""]))
    book = "\n".join(lines)
    (tmp_path / "01GEN.SFM").write_text(book)
    whole = usfm.text_rows(parsed(spark, styles, book, "01GEN"), all_text=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = usfm.read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        assert units(usfm.read_usfm(spark, str(tmp_path), styles, all_text=True)) == units(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges(spark, styles):
    assert units(usfm.text_rows(parsed(spark, styles, ""), all_text=True)) == [] and units(usfm.text_rows(parsed(spark, styles, "no markers"), all_text=True)) == []
    none = spark.createDataFrame([(None, "\\c 1\n\\p\n\\v 1 a"), ("B", None)], "text_id string, content string")
    got = usfm.text_rows(usfm.parse(usfm.sections(usfm.tokens(usfm.memory_lines(none))), styles))
    assert [r["text"] for r in got.collect()] in ([], ["a"])
    assert usfm.text_rows(usfm.parse(usfm.sections(usfm.tokens(usfm.memory_lines(none.limit(0)))), styles)).count() == 0
