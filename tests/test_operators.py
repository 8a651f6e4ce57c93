"""Row operations, alignment of corpora and text functions against known values."""

import pytest
from corpusloom.functions import segments
from corpusloom.functions import text as fn
from corpusloom.operators import joins, rows
from corpusloom.sources import text_files
from pyspark.sql import functions as F

SS, IR, RS = 1, 2, 4


def corpus(spark, items):
    data = [("text1", ref, text.split(), flags) for ref, text, flags in items]
    return spark.createDataFrame(data, "text_id string, ref bigint, segment array<string>, flags int")


def plain(n):
    return [(i, f"target segment {i} .", SS) for i in range(1, n + 1)]


def aligned(df):
    return sorted((r["source_refs"], r["target_refs"], " ".join(r["source_segment"]), " ".join(r["target_segment"])) for r in df.collect())


def test_duplicate_refs_pair_in_all_ways(spark):
    s = corpus(spark, [(1, "a", SS), (2, "b", SS), (2, "c", SS), (3, "d", SS)])
    got = joins.align_rows(s, s)
    assert got.count() == 6
    both = got.where("ref = 2").select(F.array_join("source_segment", "").alias("s"), F.array_join("target_segment", "").alias("t")).collect()
    assert sorted((r["s"], r["t"]) for r in both) == [("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")]


@pytest.mark.parametrize("switches, refs", [((False, False), [2]), ((True, False), [1, 2]), ((False, True), [2, 3]), ((True, True), [1, 2, 3])])
def test_missing_rows(spark, switches, refs):
    s, t = corpus(spark, [(1, "a", SS), (2, "b", SS)]), corpus(spark, [(2, "x", SS), (3, "y", SS)])
    assert sorted(r["ref"] for r in joins.align_rows(s, t, *switches).collect()) == refs


def test_range(spark):
    s = corpus(spark, [(1, "source segment 1 .", SS), (2, "source segment 2 . source segment 3 .", IR | RS), (3, "", IR), (4, "source segment 4 .", SS)])
    got = aligned(joins.align_ranges(s, corpus(spark, plain(4))))
    assert [g[:2] for g in got] == [([1], [1]), ([2, 3], [2, 3]), ([4], [4])]
    assert got[1][2:] == ("source segment 2 . source segment 3 .", "target segment 2 . target segment 3 .")


def test_overlapping_ranges(spark):
    s = corpus(spark, [(1, "source segment 1 .", SS), (2, "source segment 2 . source segment 3 .", SS | IR | RS), (3, "", IR)])
    t = corpus(spark, [(1, "target segment 1 . target segment 2 .", SS | IR | RS), (2, "", IR), (3, "target segment 3 .", SS)])
    got = aligned(joins.align_ranges(s, t))
    assert [g[:2] for g in got] == [([1, 2, 3], [1, 2, 3])]


def test_range_with_all_target_rows(spark):
    s = corpus(spark, [(1, "source segment 1 .", SS), (2, "source segment 2 . source segment 3 .", IR | RS), (3, "", IR), (4, "source segment 4 .", SS)])
    got = aligned(joins.align_ranges(s, corpus(spark, plain(4)), all_target=True))
    assert len(got) == 4 and got[2][2] == ""


def test_choose_first(spark):
    a, b = corpus(spark, [(1, "a", SS), (2, "", SS)]), corpus(spark, [(1, "x", SS), (2, "y", SS), (3, "z", SS), (4, "", SS)])
    got = {r["ref"]: (r["segment"], r["corpus_no"]) for r in joins.choose_first([a, b]).collect()}
    assert got == {1: (["a"], 0), 2: (["y"], 1), 3: (["z"], 1), 4: ([], -1)}
    drawn = {r["ref"]: r["corpus_no"] for r in joins.choose_random([a, b], 3).collect()}
    assert drawn[2] == drawn[3] == 1 and drawn[4] == -1 and drawn[1] in (0, 1)


def test_split(spark):
    c = corpus(spark, [(i, "a" if i % 5 else "", SS) for i in range(100)])
    assert rows.split(c, F.col("ref")).where("is_split").count() == 10
    assert rows.split(c, F.col("ref"), percent=0.5, size=7).where("is_split").count() == 7
    got = rows.split(c, F.col("ref"), size=1000, include_empty=False)
    assert got.where("is_split").count() == 80 and got.where("is_split and size(segment) = 0").count() == 0
    assert rows.split(c.limit(0), F.col("ref")).count() == 0


def test_filters_and_order(spark):
    c = corpus(spark, [(3, "c d", SS), (1, "", SS), (2, "a b", SS)])
    assert [r["ref"] for r in rows.take(c, 2, ["ref"]).collect()] == [1, 2]
    assert rows.where_nonempty(c).count() == 2 and rows.filter_texts(c, None).count() == 3 and rows.filter_texts(c, ["x"]).count() == 0
    assert {r["ref"]: r["index"] for r in rows.with_index(c, ["ref"], ["text_id"]).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["corpus_no"] for r in rows.flatten([c, c]).collect()} == {0, 1}


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("This isn't a test.", "This isn't a test ."), ("He had $50.", "He had $ 50 ."), ("", ""), ("a-b, c:d www.example.com/x ...", "a-b , c:d www.example.com/x ..."), ("He said, \"Hi!\"", 'He said , " Hi ! "')],
)
def test_latin_tokens(spark, text, want):
    assert " ".join(one(spark, text, fn.latin_tokens)) == want


def test_latin_abbreviations(spark):
    assert one(spark, "Mr. Smith went to Washington.", lambda c: fn.latin_tokens(c, ("mr", "dr", "ms"))) == ["Mr.", "Smith", "went", "to", "Washington", "."]


def test_latin_detokenize(spark):
    for text in ("This isn't a test.", "He had $50.", 'He said, "Hi!"', "(a) and/or b"):
        assert one(spark, text, lambda c: segments.latin_detokenize(fn.latin_tokens(c))) == text


def test_text_functions(spark):
    assert one(spark, "a\r\n\nb\rc\n", fn.line_segments) == ["a", "", "b", "c"]
    assert one(spark, "a​b ﻿c", fn.whitespace_tokens) == ["a", "b", "c"]
    assert one(spark, "x", lambda c: fn.escape_spaces(F.array(F.lit(" "), c))) == ["<space>", "x"]
    assert one(spark, "x", lambda c: fn.unescape_spaces(F.array(F.lit("<space>"), c))) == [" ", "x"]
    for text, ends in (("He said 'go!' ", True), ("He (went.)", True), ("He went", False), ("", False)):
        assert one(spark, text, fn.has_sentence_ending) is ends
    assert one(spark, "THE CAT. \" BIG dog", lambda c: fn.to_sentence_case(F.split(F.regexp_replace(c, "[.]", " ."), " "))) == ["The", "cat", ".", '"', "Big", "dog"]
    assert one(spark, "élan VITAL", fn.capitalize) == "Élan VITAL" and one(spark, "aBC", fn.to_title_case) == "Abc"
    assert one(spark, "Abc", fn.is_title_case) is True and one(spark, "ABc", fn.is_title_case) is False


def test_corpus_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("s_1_1\tSection one, sentence one.\tsentence_start\ns_1_2\tSection one, sentence two. sentence three.\tsentence_start,in_range,range_start\ns_1_3\t\tin_range\ns_2_1\tSection two, sentence one.\tss\n")
    (tmp_path / "three.txt").write_text("Line one.\nLine two.\n\nLine four.")
    got = sorted(text_files.read_corpus(spark, str(tmp_path / "one.txt")).collect(), key=lambda r: r["seq"])
    assert [(r["ref"], r["flags"]) for r in got] == [(["s", "1", "1"], 1), (["s", "1", "2"], 7), (["s", "1", "3"], 2), (["s", "2", "1"], 1)]
    assert got[2]["segment"] == [] and got[0]["text_id"] == "one"
    bare = sorted(text_files.read_corpus(spark, str(tmp_path / "three.txt"), "t").collect(), key=lambda r: r["seq"])
    assert [(r["ref"], r["segment"]) for r in bare] == [(["1"], ["Line one."]), (["2"], ["Line two."]), (["3"], []), (["4"], ["Line four."])]


def test_alignment_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0-0 1-2:0.5 NULL-3\ntext_5\t2-1\n")
    got = [[(p["i"], p["j"]) for p in r["pairs"]] for r in text_files.read_alignments(spark, str(tmp_path / "p.txt")).collect()]
    assert sorted(got) == [[(0, 0), (1, 2), (-1, 3)], [(2, 1)]]
    (tmp_path / "g.txt").write_text("# c\nx y z\nNULL ({ 2 }) a ({ 1 }) b ({ 2 3 })\n")
    r = text_files.read_giza(spark, str(tmp_path / "g.txt")).first()
    assert (r["source"], r["target"], [(p["i"], p["j"]) for p in r["pairs"]]) == (["a", "b"], ["x", "y", "z"], [(0, 0), (1, 1), (1, 2)])


def test_capitalize_equals_its_sql(spark, tmp_path):
    from corpusloom import catalog

    letters = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    texts = [None, "", "ß oder so", "ŉ ΟΔΟΣ", "ὀδΥΣΣΕΎΣ İI", *letters, *[f"A{c}b" for c in letters]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["capitalize"](spark, str(tmp_path)).collect()}
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got ^ set(duckdb.execute(catalog.ORACLE["capitalize"]).fetchall()) == set()
