"""Functions and operators with a state from token to token, N-way alignment, sequences, alignment matrices."""

import random

import pytest
from corpusloom.functions import segments
from corpusloom.functions import text as fn
from corpusloom.operators import evaluation, joins, quotations, rows, sequences, word_alignment
from corpusloom.sources import text_files
from pyspark.sql import functions as F


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def corpus(spark, items):
    return spark.createDataFrame([("text1", ref, text.split(), flags) for ref, text, flags in items], "text_id string, ref bigint, segment array<string>, flags int")


def test_three_corpora_with_repeated_references(spark):
    c = corpus(spark, [(1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1)])
    got = joins.align_many([c, c, c], [False] * 3)
    assert got.count() == 10 and len({tuple(map(tuple, r["segments"])) for r in got.where("ref = 2").collect()}) == 8


def test_rows_of_corpora_that_keep_all(spark):
    a, b, c = corpus(spark, [(2, "x", 1)]), corpus(spark, [(1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1)]), corpus(spark, [(1, "y", 1)])
    assert joins.align_many([a, b, c], [True] * 3).count() == 4
    assert sorted(r["ref"] for r in joins.align_many([a, b, c], [False, False, True]).collect()) == [1]
    assert joins.align_many([a, b, c], [False] * 3).count() == 0


def test_three_corpora_with_ranges(spark):
    plain = [(i, f"p{i}", 1) for i in range(1, 5)]
    ranged = [(1, "r1", 1), (2, "r2 r3", 6), (3, "", 2), (4, "r4", 1)]
    got = sorted(joins.align_many_ranges([corpus(spark, ranged), corpus(spark, plain), corpus(spark, plain)], [False] * 3).collect(), key=lambda r: r["ref"])
    assert [r["refs"] for r in got] == [[[1]] * 3, [[2, 3]] * 3, [[4]] * 3]
    assert [" ".join(s) for s in got[1]["segments"]] == ["r2 r3", "p2 p3", "p2 p3"]
    overlapping = [[(1, "a", 1), (2, "b c", 7), (3, "", 2)], [(1, "d e", 7), (2, "", 2), (3, "f", 1)]]
    got = joins.align_many_ranges([corpus(spark, x) for x in overlapping], [False] * 2).collect()
    assert [r["refs"] for r in got] == [[[1, 2, 3], [1, 2, 3]]]


def test_index_batches_and_zip(spark):
    r = random.Random(1)
    data = [(f"t{r.randrange(3)}", r.randrange(50)) for _ in range(400)] + [("t0", None), (None, 3)]
    df = spark.createDataFrame(data, "text_id string, ref bigint").withColumn("u", F.monotonically_increasing_id())
    got = rows.with_index(df, ["ref", "u"], ["text_id"], parts=7).collect()
    for t in {d[0] for d in data}:
        mine = sorted((x for x in got if x["text_id"] == t), key=lambda x: x["index"])
        assert [x["index"] for x in mine] == list(range(len(mine)))
        order = [(x["ref"] is not None, x["ref"] or 0, x["u"]) for x in mine]
        assert order == sorted(order)
    assert {x["batch"] for x in rows.batches(df, 100, ["ref", "u"], ["text_id"]).where("text_id = 't0'").collect()} <= {0, 1, 2}
    short = df.where("text_id = 't1'").limit(5)
    assert rows.zip_many([df, short], ["ref", "u"], ["text_id"]).count() == short.count()


@pytest.mark.parametrize("size", [0, 1, 7, 50, 200])
def test_split_takes_exactly_so_many_rows(spark, size):
    df = spark.createDataFrame([("t", i % 40) for i in range(200)], "text_id string, ref bigint").withColumn("segment", F.array(F.lit("x")))
    assert rows.split(df, F.col("ref"), size=size).where("is_split").count() == size  # five rows have each hash


def test_normal_forms(spark):
    assert one(spark, "éﬁ", lambda c: segments.normalize(c, "NFC")) == "éﬁ"
    assert one(spark, "éﬁ", lambda c: segments.normalize(c, "NFKD")) == "éfi"
    assert one(spark, None, lambda c: segments.normalize(c)) is None
    with pytest.raises(ValueError):
        segments.normalize(F.lit("x"), "NFX")


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("This is one sentence", ["This is one sentence"]),
        ("This is the first. And the second.", ["This is the first.", "And the second."]),
        ("Line one.\nLine two, still\nand three.", ["Line one.", "Line two, still", "and three."]),
        ('"Is it?" he asked. No.', ['"Is it?" he asked.', "No."]),
        ('He said, "Go." Then he left.', ['He said, "Go."', "Then he left."]),
        ("What?! (Really.) Yes", ["What?", "! (Really.)", "Yes"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, segments.sentences) == want


def test_abbreviations_and_ranges(spark):
    assert one(spark, "Mr. Smith went. He left.", lambda c: segments.sentences(c, ("mr",))) == ["Mr. Smith went.", "He left."]
    text = "See http://a.b/c?d, www.x.org; isn't $5 ü.\r\n«Ça»"
    ranges = one(spark, text, segments.latin_ranges)
    assert [text[r["start"] : r["end"]] for r in ranges] == one(spark, text, fn.latin_tokens)
    assert one(spark, text, lambda c: segments.split_ranges(c, segments.latin_ranges(c))) == one(spark, text, fn.latin_tokens)


@pytest.mark.parametrize(
    "text, want",
    [
        ("see http://www.test.com/path, now", ["see", "http://www.test.com/path", ",", "now"]),
        ("WWW.Test.org/a/ (www.x.de)", ["WWW.Test.org/a/", "(", "www.x.de", ")"]),
        ("xwww.test.com", ["xwww.test.com"]),
        ("ftp://h/x_1).", ["ftp://h/x_1", ")", "."]),
    ],
)
def test_addresses(spark, text, want):
    assert one(spark, text, fn.latin_tokens) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("\u200b", []),
        ("ក\u200bខ គ\u200bឃ។", ["ក", "ខ", " ", "គ", "ឃ", "។"]),
        ("ก\u200bข?  ค «ง» จ.", ["ก", "ข", "?", "ค", "«", "ง", "»", "จ", "."]),
        ("ก  ข 7,999 ค", ["ก", "  ", "ข", " ", "7,999", " ", "ค"]),
        ("ก\ufeffข http://a.b/c\u200bง", ["ก", "ข", " ", "http://a.b/c", "ง"]),
    ],
)
def test_zero_width_tokens(spark, text, want):
    assert one(spark, text, fn.zwsp_tokens) == want


@pytest.mark.parametrize("text, want", [("! No. «Yes.» he said. A", ["!", "No. «", "Yes.» he said.", "A"]), (". . a", [".", ". a"]), ("A. ) b. C", ["A. ) b.", "C"])])
def test_sentences_of_marks(spark, text, want):
    assert one(spark, text, segments.sentences) == want


def test_detokenizers(spark):
    join = lambda f, *t: spark.createDataFrame([(list(t),)], "t array<string>").select(f(F.col("t")).alias("x")).first()["x"]
    assert join(segments.latin_detokenize, '"', "Is", "'", "it", "'", "?", '"', "he", "asked", "for", "$", "5", "/", "day", ".") == "\"Is 'it'?\" he asked for $5/day."
    assert join(segments.latin_detokenize, "«", "a", "»", "(", "b", ")", "<", "c", ">") == "«a» (b) <c>"
    assert join(segments.zwsp_detokenize, "a", "b", ",", "c", " ", "d", "(", "e", ")") == "a​b, c d (e)"
    assert join(segments.whitespace_detokenize, "a", "b") == "a b" and join(segments.latin_detokenize) == ""
    long = [str(i) for i in range(50_000)] + ["."]
    assert join(segments.latin_detokenize, *long) == " ".join(long[:-1]) + "."


def brute_global(a, b, gap=-1.0):
    if not a or not b:
        return gap * (len(a) + len(b))
    return max(brute_global(a[1:], b[1:], gap) + (1 if a[0] == b[0] else -1), brute_global(a[1:], b, gap) + gap, brute_global(a, b[1:], gap) + gap)


def test_alignments_of_sequences():
    r = random.Random(2)
    for _ in range(60):
        a, b = ("".join(r.choice("xyz") for _ in range(r.randint(0, 5))) for _ in range(2))
        score, columns = sequences.align(a, b, sequences.same_or_not())
        assert score == brute_global(a, b)
        assert [i for i, _ in columns if i >= 0] == list(range(len(a))) and [j for _, j in columns if j >= 0] == list(range(len(b)))
        parts = lambda s: [s[i:j] for i in range(len(s) + 1) for j in range(i, len(s) + 1)]
        assert sequences.align(a, b, sequences.same_or_not(), mode="local")[0] == max(brute_global(p, q) for p in parts(a) for q in parts(b))
        assert sequences.align(a, b, sequences.same_or_not(), mode="half-local")[0] == max(brute_global(a[:i], b[:j]) for i in range(len(a) + 1) for j in range(len(b) + 1))
    assert sequences.align("abcdef", "cdefgh", sequences.same_or_not(), mode="semi-global") == (4.0, [(2, 0), (3, 1), (4, 2), (5, 3)])
    assert sequences.distance("kitten", "sitting") == 3 and sequences.prefix_distance("ab", "abcdef") == 0 and sequences.distance("", "abc") == 3


def test_aligned_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c"]), (2, None, ["a"]), (3, [], [])], "id int, p array<string>, q array<string>")
    got = {r["id"]: r for r in sequences.aligned(df, "p", "q").collect()}
    assert got[1]["score"] == 1.0 and got[2]["score"] == -1.0 and got[3]["columns"] == []
    assert {r["id"]: r["distance"] for r in sequences.distances(df, "p", "q").collect()} == {1: 1, 2: 1, 3: 0}
    words = spark.createDataFrame([(1, ["the", "colour", "red"], ["a", "color", "red"])], "id int, p array<string>, q array<string>")
    pairs = lambda least: [tuple(p) for p in sequences.edit_pairs(words, "p", "q", least).first()["pairs"]]
    assert pairs(None) == [(2, 2)] and pairs(0.7) == [(1, 1), (2, 2)]


def test_symmetrization_by_priority_and_och():
    a, b = {(0, 0), (1, 1)}, {(0, 0), (1, 2), (3, 3)}
    assert word_alignment.symmetrize(a, b, "priority") == {(0, 0), (1, 1), (1, 2), (3, 3)}
    square = {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert word_alignment.symmetrize({(0, 0), (0, 1), (1, 0)}, square, "och") == square
    assert word_alignment.symmetrize({(0, 0), (0, 1), (1, 0)}, square, "priority") == square - {(1, 1)}


def test_matrix_operations(spark):
    df = spark.createDataFrame([([(0, 1), (2, 0)],)], "p array<struct<i:int,j:int>>")
    p = F.col("p")
    near = lambda i, j, way: word_alignment.neighbour_aligned(p, F.lit(i), F.lit(j), way)
    got = df.select(word_alignment.transpose(p).alias("t"), word_alignment.resize(p, F.lit(2), F.lit(2)).alias("r"), word_alignment.with_nulls(p, F.lit(3), F.lit(3)).alias("n"), near(0, 0, "across").alias("a"), near(1, 0, "along").alias("b"), near(1, 0, "diagonal").alias("c"), near(2, 2, "across").alias("d")).first()
    assert [tuple(x) for x in got["t"]] == [(0, 2), (1, 0)] and [tuple(x) for x in got["r"]] == [(0, 1)]
    assert [tuple(x) for x in got["n"]] == [(-1, 2), (0, 1), (1, -1), (2, 0)] and (got["a"], got["b"], got["c"], got["d"]) == (True, True, True, False)


def test_scored_pairs_and_giza(spark, tmp_path):
    text = "0-1:0.5:0.25 2-0 1-NULL:0.125"
    pairs = one(spark, text, word_alignment.from_pharaoh_scored)
    assert [tuple(p) for p in pairs] == [(0, 1, 0.5, 0.25), (2, 0, -1.0, -1.0), (1, -1, 0.125, -1.0)]
    assert one(spark, text, lambda c: word_alignment.to_pharaoh_scored(word_alignment.from_pharaoh_scored(c))) == text.replace("NULL", "-1")
    (tmp_path / "p.txt").write_text(text.replace("1-NULL:0.125", "") + "\n")
    assert text_files.read_alignments(spark, str(tmp_path / "p.txt"), scores=True).first()["pairs"][0]["tscore"] == 0.5
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y", "z"], [(0, 1), (0, 0)])], "n int, s array<string>, t array<string>, p array<struct<i:int,j:int>>")
    lines = df.select(word_alignment.to_giza(F.col("n"), F.col("s"), F.col("t"), F.col("p")).alias("x")).first()["x"].split("\n")
    assert lines[1:] == ["x y z", "NULL ({ 3 }) a ({ 1 2 }) b ({ })"]
    (tmp_path / "g.txt").write_text("\n".join(lines) + "\n")
    back = text_files.read_giza(spark, str(tmp_path / "g.txt")).first()
    assert back["source"] == ["a", "b"] and sorted(map(tuple, back["pairs"])) == [(0, 0), (0, 1)]


def test_marks_in_context(spark):
    got = quotations.marks_in_context(spark.createDataFrame([(1, "“Don't <<go>>”, he said")], "id int, text string"), ["id"]).orderBy("k").collect()
    assert [(r["mark"], r["before"], r["after"], r["direction"]) for r in got] == [("“", "", "D", "opening"), ("'", "n", "t", "apostrophe"), ("<<", " ", "g", "opening"), (">>", "o", "”", "unclear"), ("”", ">", ",", "unclear")]


def test_metrics_and_known_pairs(spark):
    df = spark.createDataFrame([(3, 30, 10, 4, 2, 1, 1, 0), (2, 20, 5, 1, 1, 0, 0, 0)], "actions int, characters int, suggestions int, accepted int, full int, initial int, final int, middle int")
    got = evaluation.suggestion_metrics(df).first()
    assert (got["ksmr"], got["precision"], got["full_share"]) == (0.1, 5 / 15, 3 / 5)
    assert evaluation.suggestion_metrics(df.limit(0)).first()["ksmr"] == 0.0
    pairs = spark.createDataFrame([([(0, 0), (1, 1), (2, 1)], [(1, 2)])], "e array<struct<i:int,j:int>>, k array<struct<i:int,j:int>>")
    assert [tuple(x) for x in pairs.select(word_alignment.merge_known(F.col("e"), F.col("k")).alias("x")).first()["x"]] == [(0, 0), (1, 2), (2, 1)]


def test_parallel_files_agree_on_equal_references(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, [f"s{i}"], [f"t{i}"]) for i in range(50)], "text_id string, ref bigint, source_segment array<string>, target_segment array<string>").repartition(5)
    text_files.write_parallel(df, str(tmp_path / "o"))
    lines = lambda name: [x for f in sorted((tmp_path / "o" / name).glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines("source")) == 50 and all(a[1:] == b[1:] for a, b in zip(lines("source"), lines("target"), strict=True))


def test_ranges_of_a_large_batch_are_no_python_objects():
    """A batch of 10,000 long texts has millions of ranges: they take the space of their numbers."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["ab, " * 2000, None, ""] * 60)
    tracemalloc.start()
    got = segments.latin_ranges.__globals__["_ranges"](lambda t: segments._words(t, ()), False).func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) if x.is_valid else None for x in got[:3]] == [4000, None, 0] and peak < 60 * 4000 * 40
