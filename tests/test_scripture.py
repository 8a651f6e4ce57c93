"""Scripture files, verses, quotation conventions, feature structures, exclusive links and phrases."""

import random

import pytest
from corpusloom.operators import features, morphology, quotations, verses, word_alignment
from corpusloom.plans import scripture as plans
from corpusloom.sources import scripture
from pyspark.sql import functions as F

USFM = r"""\id MAT - a test
\h Matthew
\mt Matthew
\c 1
\s A heading
\p
\v 1 Verse one,\f + \fr 1:1 \ft A note.\f* and
\q1 more of it
\s2 Another heading
\p
\v 2-3 "Verses" \w two|lemma="two"\w* to three.
\c 2
\p Before any verse
\v 1 End.
"""
USX = """<usx version="3.0"><book code="MAT" style="id">- a test</book><para style="h">Matthew</para>
<chapter number="1" style="c" sid="MAT 1"/><para style="s">A heading</para>
<para style="p"><verse number="1" style="v" sid="MAT 1:1"/>Verse one,<note caller="+" style="f"><char style="ft">A note.</char></note> and</para>
<para style="q1">more of it<verse eid="MAT 1:1"/></para>
<para style="p"><verse number="2-3" style="v" sid="MAT 1:2-3"/>&quot;Verses&quot; <char style="w">two</char> to three.<verse eid="MAT 1:2-3"/></para><chapter eid="MAT 1"/>
<chapter number="2" style="c" sid="MAT 2"/><para style="p">Before any verse <verse number="1" style="v" sid="MAT 2:1"/>End.<verse eid="MAT 2:1"/></para></usx>"""
VERSES = [("MAT", "1", "1", "Verse one, and more of it", True), ("MAT", "1", "2-3", '"Verses" two to three.', False), ("MAT", "2", "1", "End.", True)]


@pytest.mark.parametrize(("content", "cut"), [(USFM, scripture.usfm_tokens), (USX, scripture.usx_tokens)])
def test_verses_of_files(spark, content, cut):
    files = spark.createDataFrame([("a", content), ("b", ""), ("c", None)], "text_id string, content string")
    got = scripture.verse_rows(cut(files)).orderBy("seq").collect()
    assert [(r["book"], r["chapter"], r["verse"], r["text"], r["sentence_start"]) for r in got] == VERSES


def test_read_usfm(spark, tmp_path):
    (tmp_path / "41MAT.SFM").write_text(USFM)
    got = scripture.read_usfm(spark, str(tmp_path)).collect()
    assert {r["text_id"] for r in got} == {"41MAT"} and len(got) == 3


def test_merge_verse_ranges(spark):
    rows = [("a", "1-3"), ("a", "3,5"), ("b", "2a"), ("b", "2b"), ("b", "7"), ("c", "4a"), ("c", "4"), ("c", "5"), ("d", "x")]
    got = verses.merge_verse_ranges(spark.createDataFrame(rows, "k string, verse string"), "k").collect()
    assert {r["k"]: r["verse"] for r in got} == {"a": "1-3,5", "b": "2a,2b,7", "c": "4-5"}


def test_extract(spark):
    refs = verses.verse_refs(spark.createDataFrame([("MAT", 1, 4), ("MAT", 2, 0)], "book string, chapter int, last_verse int"))
    rows = spark.createDataFrame([("MAT", "1", "1-2", "both", 0), ("MAT", "1", "3a", "one", 1), ("MAT", "1", "3b", "two", 2), ("MAT", "1", "9", "x", 3)], "book string, chapter string, verse string, text string, seq int")
    got = verses.extract(refs, rows).orderBy("verse").collect()
    assert [r["text"] for r in got] == ["both", "<range>", "one two", ""]


def test_chapters():
    n = dict.fromkeys(verses.BOOKS, 5)
    assert verses.chapters("", n) == {}
    assert verses.chapters("MAT1-3,5;GEN", n) == {"MAT": [1, 2, 3, 5], "GEN": []}
    assert verses.chapters("MAT, MRK", n) == {"MAT": [], "MRK": []}
    assert verses.chapters("MAT-LUK;-MRK;-LUK1,2", n) == {"MAT": [], "LUK": [3, 4, 5]}
    assert len(verses.chapters("NT", n)) == 27 and len(verses.chapters("OT", n)) == 39
    assert verses.chapters("MAT1-4;MAT5", n) == {"MAT": []}
    for wrong in ("XYZ", "MAT9", "MRK-MAT", "MAT3-2", "-MAT", "MAT1;-MAT2"):
        with pytest.raises(ValueError):
            verses.chapters(wrong, n)


def test_quotations(spark):
    assert quotations.conventions(spark).count() == sum(len(v.split()) for v in quotations.STANDARD.values()) and len(quotations.STANDARD) == 23
    seen = [("a", ["“", "‘"], ["”", "’"]), ("b", ["«"], ["»"]), ("c", ["“"], ["»"]), ("d", [], [])]
    got = quotations.compatible(spark.createDataFrame(seen, "k string, opening array<string>, closing array<string>"), "k").collect()
    by = {k: {r["name"] for r in got if r["k"] == k} for k in "abcd"}
    assert by["a"] == {"standard_english", "british_english"} and not by["c"] and not by["d"]
    assert {"standard_french", "western_european", "standard_russian"} <= by["b"]
    marks = [("a", 1, "opening", "“")] * 3 + [("a", 1, "closing", "”")] * 2 + [("a", 1, "closing", '"')] + [("a", 2, "opening", "‘")] * 2
    counts = quotations.tabulate(spark.createDataFrame(marks, "k string, depth int, direction string, mark string"), "k")
    score = {r["name"]: r["score"] for r in quotations.similarity(counts, "k").collect()}
    assert score["standard_english"] == pytest.approx((5 + 5 / 6 * 2) / 8) and score["standard_french"] == 0


def test_features(spark):
    rows = [({"t": 3, "u": 1}, {"t": 2, "v": 4}), ({"t": 1}, {"t": 2}), ({"t": 3}, {"t": 1}), ({}, {"t": 1})]
    df = spark.createDataFrame(rows, "a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    got = df.select(features.unify(a, b), features.subsumes(a, b), features.priority_union(a, b)).collect()
    assert [tuple(r) for r in got] == [
        ({"t": 2, "u": 1, "v": 4}, False, {"t": 2, "u": 1, "v": 4}),
        (None, False, {"t": 2}),
        ({"t": 1}, True, {"t": 1}),
        ({"t": 1}, True, {"t": 1}),
    ]


def test_exclusive_links_equal_greedy(spark):
    r = random.Random(3)
    rows = [(s, [(i, j, float(r.randint(0, 4))) for i in range(r.randint(1, 5)) for j in range(4)]) for s in range(30)]
    df = spark.createDataFrame(rows, "seg int, scores array<struct<i:int,j:int,score:double>>")
    got = {x["seg"]: [tuple(p) for p in x["pairs"]] for x in df.select("seg", word_alignment.exclusive_links(F.col("scores")).alias("pairs")).collect()}
    for seg, scores in rows:
        want = []
        for i, j, _ in sorted(scores, key=lambda p: (-p[2], abs(p[0] - p[1]), p[0], p[1])):
            if all(i != a and j != b for a, b in want):
                want.append((i, j))
        assert got[seg] == sorted(want)


def test_links_of_all_pairs_equal_greedy(spark):
    r = random.Random(5)
    rows = [(s, n, [float(r.randint(0, 4)) for _ in range(m * n)]) for s, (m, n) in enumerate((r.randint(0, 20), r.randint(0, 20)) for _ in range(30))]
    df = spark.createDataFrame(rows, "seg int, n int, scores array<double>")
    struct = F.transform("scores", lambda x, k: F.struct(F.floor(k / F.col("n")).alias("i"), (k % F.col("n")).alias("j"), x.alias("score")))
    got = {x["seg"]: x["pairs"] for x in word_alignment.exclusive_links_of_all(df, "n", "scores").collect()}
    assert got == {x["seg"]: x["b"] for x in df.select("seg", word_alignment.exclusive_links(struct).alias("b")).collect()} and len(got) == 30


def test_alignment_queries_take_whole_segments(spark, tmp_path):
    words = [chr(97 + i) * 3 for i in range(20)]
    rows = [(0, 0, "user", " ".join(words)), (0, 1, "assistant", " ".join(words))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    links = plans.exclusive_links(spark, str(tmp_path)).first()["pairs"]
    assert links == " ".join(f"{i}-{i}" for i in range(20))
    phrases = {x["src"] for x in plans.phrase_table(spark, str(tmp_path)).collect()}
    assert phrases == {" ".join(words[a:b]) for a in range(20) for b in range(a + 1, min(a + 7, 20) + 1)}
    assert {x["trg"] for x in plans.ibm2_ttable(spark, str(tmp_path)).collect()} == set(words)


def test_phrases_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for seg in range(20):
        s, t = [f"s{i}" for i in range(r.randint(1, 6))], [f"t{i}" for i in range(r.randint(1, 6))]
        rows.append((seg, s, t, sorted({(r.randrange(len(s)), r.randrange(len(t))) for _ in range(r.randint(0, 5))})))
    df = spark.createDataFrame(rows, "seg int, source_segment array<string>, target_segment array<string>, pairs array<struct<i:int,j:int>>")
    want = []
    for seg, s, t, pairs in rows:
        for a in range(len(s)):
            for b in range(a, min(len(s), a + 3)):
                js = [j for i, j in pairs if a <= i <= b]
                if js and max(js) - min(js) < 3 and all(a <= i <= b for i, j in pairs if min(js) <= j <= max(js)):
                    want.append((seg, " ".join(s[a : b + 1]), " ".join(t[min(js) : max(js) + 1])))
    assert sorted(tuple(x) for x in word_alignment.phrase_pairs(df, 3).collect()) == sorted(want)


def test_ibm2_sums_to_one(spark):
    rows = [(0, ["das", "Haus"], ["the", "house"]), (1, ["das", "Buch"], ["the", "book"]), (2, ["ein", "Buch"], ["a", "book"])]
    t, a = word_alignment.train_ibm2(spark.createDataFrame(rows, "seg int, source_segment array<string>, target_segment array<string>"))
    assert all(abs(x["p"] - 1) < 1e-9 for x in t.groupBy("src").agg(F.sum("prob").alias("p")).collect())
    assert all(abs(x["p"] - 1) < 1e-9 for x in a.groupBy("j", "n_source", "n_target").agg(F.sum("prob").alias("p")).collect())
    best = {x["src"]: x["trg"] for x in t.groupBy("src").agg(F.max_by("trg", "prob").alias("trg")).collect()}
    assert best["Haus"] == "house" and best["Buch"] == "book" and best["ein"] == "a"


def test_identify_affixes(spark):
    rows = [("s", 9.0), ("es", 7.0), ("ing", 8.0), ("ting", 8.0), ("ling", 8.5), ("x", 1.0)]
    got = morphology.identify_affixes(spark.createDataFrame(rows, "affix string, score double"), 5.0).collect()
    assert {x["affix"] for x in got} == {"s", "ing", "ling"}
