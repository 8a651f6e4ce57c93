"""Resolution of quotation marks, detection and change of conventions; operations on feature structures."""

import pytest
from corpusloom.operators import features, quote_resolution
from pyspark.sql import functions as F

ENGLISH = quote_resolution.levels_of("standard_english")
TYPEWRITER = quote_resolution.levels_of("typewriter_english")


@pytest.mark.parametrize(
    "text, levels, want, issues",
    [
        ("“It isn’t ‘so’,” he said.", ENGLISH, [("“", 1, "opening"), ("‘", 2, "opening"), ("’", 2, "closing"), ("”", 1, "closing")], 0),
        ("\"It isn't 'so',\" he said.", TYPEWRITER, [('"', 1, "opening"), ("'", 2, "opening"), ("'", 2, "closing"), ('"', 1, "closing")], 0),
        ("“One\n“two\nthree.”", ENGLISH, [("“", 1, "opening"), ("“", 1, "continuer"), ("”", 1, "closing")], 0),
        ("He said, “Go.", ENGLISH, [("“", 1, "opening")], 1),
        ("No” he said", ENGLISH, [], 1),
        ("the boys’ house", ENGLISH, [], 0),
        ("", ENGLISH, [], 0),
        ("“a ‘b “c” d’ e”", ENGLISH, [("“", 1, "opening"), ("‘", 2, "opening"), ("“", 3, "opening"), ("”", 3, "closing"), ("’", 2, "closing"), ("”", 1, "closing")], 0),
    ],
)
def test_marks_are_resolved(text, levels, want, issues):
    marks, found = quote_resolution.resolve(text, levels)
    assert [x[1:] for x in marks] == want and found == issues and all(text.startswith(m, at) for at, m, _, _ in marks)


TEXTS = {
    "standard_english": "“It isn’t ‘so’,” he said. “Why?”",
    "british_english": "‘It isn’t “so”,’ he said. ‘Why?’",
    "standard_french": "«C'est ‹bon›», dit-il. «Oui.»",
    "standard_russian": "«Это „так“», сказал он. «Да.»",
    "central_european": "„Das ist ‚so‘“, sagte er. „Ja.“",
    "typewriter_french": "<<C'est <bon> ici>>, dit-il. <<Oui.>>",
}


def test_conventions_are_detected(spark):
    rows = [(name, t) for name, t in TEXTS.items() for _ in range(3)] + [("none", "no marks"), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, text string")
    got = {r["grp"]: r["name"] for r in quote_resolution.detect(df, ["grp"]).collect()}
    assert got == {name: name for name in TEXTS}


def test_conventions_are_changed(spark):
    df = spark.createDataFrame([(TEXTS["standard_english"],), (None,), ("",)], "text string")
    there = quote_resolution.changed(F.col("text"), "standard_english", "standard_french")
    got = [r["x"] for r in df.select(there.alias("x")).collect()]
    assert got == ["«It isn’t ‹so›,» he said. «Why?»", None, ""]
    back = df.select(quote_resolution.changed(there, "standard_french", "standard_english").alias("x")).collect()
    assert [r["x"] for r in back] == [r["text"] for r in df.collect()]
    marks = quote_resolution.resolved(df.withColumn("id", F.lit(1)), ["id"], "standard_english")
    assert marks.count() == 6 and marks.where("depth = 2").count() == 2


def test_feature_operations(spark):
    df = spark.createDataFrame([({"a": 3, "b": 1}, {"a": 6, "c": 4})], "x map<string,bigint>, y map<string,bigint>")
    got = df.select(*[f(F.col("x"), F.col("y")).alias(f.__name__) for f in (features.union, features.add, features.subtract, features.priority_union, features.unify)]).first()
    assert got.asDict() == {"union": {"a": 7}, "add": {"a": 7, "b": 1, "c": 4}, "subtract": {"a": 1, "b": 1}, "priority_union": {"a": 6, "b": 1, "c": 4}, "unify": {"a": 2, "b": 1, "c": 4}}
