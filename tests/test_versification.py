"""Conversion between numberings of verses."""

import pytest
from corpusloom.operators import joins, versification as vs
from pyspark.sql import functions as F

FILE = """# A numbering
GEN 1:31 2:24
GEN 31:54 32:33 33:20
JON 1:16 2:11
GEN 31:55 = GEN 32:1
GEN 32:1-32 = GEN 32:2-33
#! &JON 1:16-17 = JON 1:16
JON 2:1 = JON 2:1-2
-GEN 2:3
"""
OTHER = "GEN 1:31\nGEN 5:1-2 = GEN 32:1-2\nGEN 2:25  # longer\n"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("vrs")
    (at / "a.vrs").write_text(FILE)
    (at / "b.vrs").write_text("GEN 33:19\nGEN 31:55 = GEN 40:1\n")
    (at / "c.vrs").write_text(OTHER)
    return at


def rows(spark, *verses):
    return spark.createDataFrame([("t", i, b, c, v, [f"{b}{c}:{v}"], 1) for i, (b, c, v) in enumerate(verses)], "text_id string, seq int, book string, chapter int, verse int, segment array<string>, flags int")


def refs(df):
    return [(r["ref_book"], r["ref_chapter"], r["ref_verse"], r["ref_last"]) for r in df.orderBy("seq").collect()]


def test_files(spark, files):
    v = vs.read_versification(spark, str(files / "a.vrs"))
    assert {(r["book"], r["chapter"], r["last_verse"]) for r in v.lengths.collect()} == {("GEN", 1, 31), ("GEN", 2, 24), ("GEN", 31, 54), ("GEN", 32, 33), ("GEN", 33, 20), ("JON", 1, 16), ("JON", 2, 11)}
    assert [tuple(r) for r in v.left_out.collect()] == [("GEN", 2, 3)]
    assert v.mapped.count() == 1 + 32 + 2 + 1
    both = vs.read_versification(spark, str(files / "a.vrs"), str(files / "b.vrs"))
    assert both.lengths.where("book = 'GEN' and chapter = 33").first()["last_verse"] == 19
    assert both.mapped.where("chapter = 31").first()["to_chapter"] == 40


def test_to_the_standard_and_back(spark, files):
    a = vs.read_versification(spark, str(files / "a.vrs")).mapped
    verses = [("GEN", 1, 1), ("GEN", 31, 55), ("GEN", 32, 1), ("GEN", 32, 32), ("JON", 1, 16), ("JON", 1, 17), ("JON", 2, 1), ("GEN", None, 1)]
    there = vs.convert(rows(spark, *verses), a, None)
    assert refs(there) == [("GEN", 1, 1, 1), ("GEN", 32, 1, 1), ("GEN", 32, 2, 2), ("GEN", 32, 33, 33), ("JON", 1, 16, 16), ("JON", 1, 16, 16), ("JON", 2, 1, 2), ("GEN", None, 1, 1)]
    back = vs.convert(rows(spark, ("GEN", 32, 1), ("GEN", 32, 33), ("JON", 1, 16), ("JON", 2, 2), ("JON", 3, 1)), None, a)
    assert refs(back) == [("GEN", 31, 55, 55), ("GEN", 32, 32, 32), ("JON", 1, 16, 17), ("JON", 2, 1, 1), ("JON", 3, 1, 1)]


def test_between_two(spark, files):
    a, c = (vs.read_versification(spark, str(files / f"{x}.vrs")).mapped for x in "ac")
    assert refs(vs.convert(rows(spark, ("GEN", 31, 55), ("GEN", 32, 1), ("GEN", 32, 2)), a, c)) == [("GEN", 5, 1, 1), ("GEN", 5, 2, 2), ("GEN", 32, 3, 3)]
    assert refs(vs.convert(rows(spark, ("GEN", 5, 1), ("GEN", 5, 2)), c, a)) == [("GEN", 31, 55, 55), ("GEN", 32, 1, 1)]
    assert refs(vs.convert(rows(spark, ("JON", 2, 1)), a, a)) == [("JON", 2, 1, 1)]


def test_ranges(spark, files):
    a = vs.read_versification(spark, str(files / "a.vrs")).mapped
    df = rows(spark, ("JON", 1, 15), ("JON", 1, 16), ("JON", 1, 17), ("JON", 2, 1)).withColumn("flags", F.when(F.col("verse") == 17, 0).otherwise(1))
    got = vs.with_ranges(vs.convert(df, a, None), ["seq"]).orderBy("ref_chapter", "ref_verse", "place").collect()
    assert [(r["ref_chapter"], r["ref_verse"], r["verse"], " ".join(r["segment"]), r["flags"]) for r in got] == [
        (1, 15, 15, "JON1:15", 1), (1, 16, 16, "JON1:16 JON1:17", 7), (1, 16, 17, "", 2), (2, 1, 1, "JON2:1", 7), (2, 2, 1, "", 2),
    ]
    assert vs.with_ranges(vs.convert(df.limit(0), a, None), ["seq"]).count() == 0


def test_conversion_before_alignment(spark, files):
    """A range that a mapping makes is aligned with the other corpus' rows."""
    a = vs.read_versification(spark, str(files / "a.vrs")).mapped
    ref = (F.col("ref_chapter") * 1000 + F.col("ref_verse")).alias("ref")
    source = vs.with_ranges(vs.convert(rows(spark, ("JON", 1, 16), ("JON", 2, 1), ("JON", 2, 2)), a, None), ["seq"]).select("text_id", ref, "segment", "flags").where("ref <> 2002 or size(segment) = 0")
    target = rows(spark, ("JON", 1, 16), ("JON", 2, 1), ("JON", 2, 2)).select("text_id", (F.col("chapter") * 1000 + F.col("verse")).alias("ref"), "segment", "flags")
    got = joins.align_ranges(source, target).orderBy("ref").collect()
    assert [(r["source_refs"], r["target_refs"]) for r in got] == [([1016], [1016]), ([2001, 2002], [2001, 2002])]


def test_missing_and_extra(spark, files):
    v = vs.read_versification(spark, str(files / "c.vrs"))
    got = vs.missing(v.lengths, rows(spark, *[("GEN", 1, i) for i in range(2, 33)], *[("GEN", 2, i) for i in range(1, 26)]))
    assert {tuple(r) for r in got.collect()} == {("GEN", 1, 1, "missing"), ("GEN", 1, 32, "extra")}
