"""Statistics, evaluation, alignment and morphology against known values and brute force."""

import collections
import math

import pytest
from corpusloom.operators import evaluation, morphology, statistics, word_alignment
from corpusloom.plans import models
from corpusloom.streaming import counts as streams
from pyspark.sql import functions as F

COUNTS = "a1 b1 c2 d3 e4 f4 g4 h5 i5 j6 k6 l6 m7 n7 o8 p9 q10".split()
WORDS = "#call# #stall# #hello# #the# #a# #test# #income# #unproduce#".split()


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(c[0], int(c[1:])) for c in COUNTS], "sample string, cnt bigint")


def probs(df):
    return {r["sample"]: (r["prob"], r["unseen"]) for r in df.collect()}


def test_smoothed_probabilities(samples):
    lid = probs(statistics.lidstone(samples, gamma=1.0))
    assert lid["c"][0] == pytest.approx(0.0283, abs=1e-3) and sum(p for p, _ in lid.values()) + lid["a"][1] == pytest.approx(1)
    wb = probs(statistics.witten_bell(samples))
    assert [round(wb[k][0], 5) for k in "acdoq"] == pytest.approx([0.00952, 0.01904, 0.02857, 0.07619, 0.09523], abs=2e-5) and wb["a"][1] == pytest.approx(0.1619, abs=1e-4)
    gt = probs(statistics.good_turing_probability(samples))
    assert [gt[k][0] for k in "acdoq"] == pytest.approx([0.01765, 0.02728, 0.03682, 0.08433, 0.1033], abs=2e-4) and gt["a"][1] == pytest.approx(0.02273, abs=1e-4)


def test_ngrams(spark):
    words = spark.createDataFrame([(list(w),) for w in WORDS], "tokens array<string>")
    got = {(tuple(r["context"]), r["word"]): r["prob"] for r in statistics.ngram_max_likelihood(words, 2).collect()}
    assert [got[("a",), "l"], got[("a",), "#"], got[("l",), "l"], got[("l",), "o"], got[("l",), "#"]] == pytest.approx([2 / 3, 1 / 3, 1 / 2, 1 / 6, 1 / 3])
    three = {(tuple(r["context"]), r["word"]): r["prob"] for r in statistics.ngram_max_likelihood(words, 3).collect()}
    assert three[("a", "l"), "l"] == 1
    back = statistics.ngram_counts(words, 2, right_to_left=True).where("context = array('l') and word = 'a'").first()
    assert back["cnt"] == 2
    for f in (statistics.ngram_witten_bell, statistics.ngram_kneser_ney):
        assert all(0 < r["prob"] <= 1 for r in f(words, 3).collect())


def test_measures(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5], [0.0, 0.0])], "p array<double>, q array<double>, z array<double>")
    r = df.select(statistics.cosine(F.col("p"), F.col("z")), statistics.cosine(F.col("p"), F.col("q")), statistics.euclidean(F.col("p"), F.col("q")), statistics.kullback_leibler(F.col("p"), F.col("q")), statistics.jensen_shannon(F.col("p"), F.col("q"))).first()
    assert list(r) == pytest.approx([0, math.sqrt(0.5), math.sqrt(0.5), 1.0, 0.311278], abs=1e-6)
    logs = df.select(statistics.log_add(F.lit(math.log(0.25)), F.lit(math.log(0.5))), statistics.log_add(F.lit(statistics.LOG_ZERO), F.lit(-1.0)), statistics.log_multiply(F.lit(-1.0), F.lit(statistics.LOG_ZERO))).first()
    assert list(logs) == pytest.approx([math.log(0.75), -1.0, statistics.LOG_ZERO])
    means = spark.createDataFrame([(1, 2.0), (1, 8.0), (2, 0.0), (2, 3.0)], "k int, v double").groupBy("k").agg(statistics.geometric_mean(F.col("v")).alias("m"))
    assert {r["k"]: round(r["m"], 6) for r in means.collect()} == {1: 4.0, 2: 0.0}


def test_bleu(spark):
    rows = [("a b c d e".split(), "a b c d f".split()), ("x x x".split(), "x y z".split())]
    df = spark.createDataFrame(rows, "h array<string>, r array<string>")
    matches, totals = [0] * 4, [0] * 4
    for h, r in rows:
        for n in range(1, 5):
            a, b = (collections.Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (h, r))
            matches[n - 1] += sum((a & b).values())
            totals[n - 1] += sum(a.values())
    want = math.exp(sum(math.log(m / t) for m, t in zip(matches, totals, strict=True)) / 4)
    assert evaluation.bleu(df, "h", "r").first()["bleu"] == pytest.approx(want)
    assert evaluation.bleu(df.select(F.col("r").alias("h"), F.array(F.lit("q")).alias("r")), "h", "r").first()["bleu"] == 0


def test_alignment_scores(spark):
    found = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "seg int, i int, j int")
    gold = spark.createDataFrame([(1, 0, 0, True), (1, 1, 1, False), (1, 3, 3, True)], "seg int, i int, j int, sure boolean")
    r = evaluation.alignment_scores(found, gold).first()
    assert (r["aer"], r["precision"], r["recall"]) == pytest.approx((1 - (2 + 1) / (2 + 3), 2 / 3, 1 / 2))


def test_usability(spark):
    rows = [("MAT", 0.6220749899712906), ("MAT", 0.5416165991875662), ("MRK", 0.40324150219671917)]
    df = spark.createDataFrame(rows, "book string, confidence double")
    x = 109.6145 * F.col("confidence") - 14.0633
    got = df.select(x, evaluation.usability(x), evaluation.usability_label(evaluation.usability(x))).collect()
    assert [r[0] for r in got] == pytest.approx([54.12, 45.31, 30.14], abs=0.01) and [r[1] for r in got] == pytest.approx([0.786, 0.691, 0.465], abs=1e-3)
    assert [r[2] for r in got] == ["Green", "Yellow", "Red"]
    books = {r["book"]: r for r in evaluation.chrf3_estimates(df, 109.6145, -14.0633, "book").collect()}
    assert books["MAT"]["chrf3"] == pytest.approx(49.56, abs=0.02) and books["MAT"]["label"] == "Yellow" and books["MRK"]["label"] == "Red"
    assert [r[0] for r in df.select(evaluation.low_confidence(F.col("confidence"))).collect()] == [False, False, True]


def brute_ibm1(pairs, iterations):
    table, null = None, word_alignment.NULL
    for _ in range(iterations):
        counts = collections.defaultdict(float)
        for s, t in pairs:
            for f in t:
                z = sum(table[e, f] if table else 1.0 for e in [null, *s])
                for e in [null, *s]:
                    counts[e, f] += (table[e, f] if table else 1.0) / z
        totals = collections.defaultdict(float)
        for (e, _), c in counts.items():
            totals[e] += c
        table = {k: c / totals[k[0]] for k, c in counts.items()}
    return table


TOY = [("isthay isyay ayay esttay-N .", "this is a test N ."), ("ouyay ouldshay esttay-V oftenyay .", "you should test V often ."), ("isyay isthay orkingway ?", "is this working ?"), ("isthay isyay ayay ordway !", "this is a word !")]


def test_ibm1(spark):
    pairs = [(s.split(), t.split()) for s, t in TOY]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "seg int, source_segment array<string>, target_segment array<string>")
    table = word_alignment.train_ibm1(df, 4)
    got, want = {(r["src"], r["trg"]): r["prob"] for r in table.collect()}, brute_ibm1(pairs, 4)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    named = word_alignment.train_ibm1(df.withColumn("seg", F.struct(F.lit("t").alias("text"), "seg")), 4)
    assert {(r["src"], r["trg"]): pytest.approx(r["prob"]) for r in named.collect()} == got
    best = {(r["j"], r["i"]) for r in word_alignment.best_pairs(df, table).where("seg = 2").collect()}
    assert (2, 2) in best
    lexicon = word_alignment.lexicon(table, 0.1)
    assert lexicon.where("prob <= 0.1").count() == 0 and lexicon.count() > 0
    diagonal = {(r["src"], r["trg"]): r["prob"] for r in word_alignment.train_diagonal(df, 4).collect()}
    assert diagonal["isthay", "this"] > diagonal["isthay", "is"]


def conversations(spark, at, pairs):
    rows = [(c, turn, role, text) for c, both in enumerate(pairs) for turn, (role, text) in enumerate(zip(("user", "assistant"), both, strict=True))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_aligner_queries_take_whole_segments(spark, tmp_path):
    pairs = [("Walked walking a b c d e f g h i j k l late", "laufend lauft A B C D E F G H I J K L last last"), ("late walking", "last laufend"), ("w", " ".join(f"v{i}" for i in range(1200)))]
    got = {(r["src"], r["trg"]): r["prob"] for r in models.ibm1_ttable(spark, conversations(spark, tmp_path, pairs)).collect()}
    want = brute_ibm1([(s.lower().split(), t.lower().split()) for s, t in pairs], 4)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_segments_without_links_stay(spark, tmp_path):
    got = models.symmetrize_gdfa(spark, conversations(spark, tmp_path, [("x", "a")])).collect()
    assert [r["pairs"] for r in got] == [""]  # both words are as likely to come from the null word


def test_symmetrize(spark):
    a, b = {(0, 0), (1, 1), (2, 1)}, {(0, 0), (1, 2), (2, 1), (3, 3)}
    assert word_alignment.symmetrize(a, b, "intersection") == {(0, 0), (2, 1)} and word_alignment.symmetrize(a, b, "union") == a | b
    for h in ("och", "grow", "grow-diag", "grow-diag-final", "grow-diag-final-and"):
        got = word_alignment.symmetrize(a, b, h)
        assert a & b <= got <= a | b
    assert (3, 3) in word_alignment.symmetrize(a, b, "grow-diag-final-and")
    kind = "array<struct<i: int, j: int>>"
    df = spark.createDataFrame([(1, sorted(a), sorted(b))], f"seg int, direct {kind}, inverse {kind}")
    r = word_alignment.symmetrize_rows(df, "intersection").select(word_alignment.to_pharaoh(F.col("pairs")).alias("t")).first()
    assert r["t"] == "0-0 2-1"


def test_truecaser(spark):
    lines = ["The house is made of wood .", "I go on adventures .", "He read the book about Sherlock Holmes .", "John and I agree that you are smart ."]
    df = spark.createDataFrame([(i, x.split(), True) for i, x in enumerate(lines)], "seg int, tokens array<string>, sentence_start boolean")
    model = morphology.truecaser(df, ["seg"])
    told = spark.createDataFrame([(1, "THE ADVENTURES OF SHERLOCK HOLMES EXPLOITS HE".split())], "seg int, tokens array<string>")
    assert morphology.truecase(told, model, ["seg"]).first()["tokens"] == "the adventures of Sherlock Holmes EXPLOITS HE".split()


def test_affixes(spark):
    df = spark.createDataFrame([(w,) for w in "walking talking barking walked talked sing a".split()], "word string")
    got = {r["affix"]: r["n_words"] for r in morphology.affix_counts(df, 3).collect()}
    assert (got["ing"], got["ed"], got["g"]) == (4, 2, 4)


def test_streams(spark, tmp_path):
    rows = [(0, "a b a", "x"), (3600, "b", "y"), (3700, "a", "x")]
    spark.createDataFrame(rows, "s bigint, text string, event_type string").selectExpr("timestamp_seconds(s) AS ts", "text", "event_type", "1L AS user_id", "1.0D AS value").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert {r["word"]: r["cnt"] for r in run(streams.word_counts(stream()), "complete", "wc")} == {"a": 3, "b": 2}
    assert sorted((r["event_type"], r["n"]) for r in run(streams.event_windows(stream()), "complete", "ew")) == [("x", 1), ("x", 1), ("y", 1)]
    batch = spark.createDataFrame([("a", 2), ("b", 1)], "word string, cnt bigint")
    streams.update_table(batch, str(tmp_path / "t"), 0, ["word"])
    streams.update_table(batch, str(tmp_path / "t"), 1, ["word"])
    assert {r["word"]: r["cnt"] for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {"a": 4, "b": 2}


def test_truecased_rows_of_one_key_stay_rows(spark):
    model = spark.createDataFrame([("the", "The", 3), ("x", "X", 2)], "lower string, token string, n int")
    rows = spark.createDataFrame([(1, ["the", "x"]), (1, ["a", "x"]), (1, ["a", "x"]), (2, [])], "seg int, tokens array<string>")
    got = sorted((r["seg"], r["tokens"]) for r in morphology.truecase(rows, model, ["seg"]).collect())
    assert got == [(1, ["The", "X"]), (1, ["a", "X"]), (1, ["a", "X"]), (2, [])]
