"""The pipeline's stages on a small table, each against what it must drop or keep."""

import corpus_pipeline
import pytest
from corpusloom.llm import language_id
from pyspark.sql import functions as F

LONG = "the cat sat on the mat and looked at the dog which ran over the old bridge to the town "


@pytest.fixture
def sf_dir(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(i, f"{LONG} number {i} of many " + " ".join(f"w{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(1, 80)]
    rows += [(100, LONG * 3, "en", "s", 1), (101, LONG * 3 + " end", "en", "s", 1), (102, LONG * 3, "en", None, 1)]
    rows += [(110, "1234 !!", "en", "s", 1), (111, None, "en", "s", 1), (112, "start " + item + " end", "en", "s", 1), (113, "reach me at bob@mail.example.com please, thanks", "en", "s", 47)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    gone = {"language": {110, 111}, "near_duplicates": {101, 102}, "decontamination": {112}, "private_data": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert seen - now == gone[name], name
        seen = now
    new = docs.where("doc_id = 113").first()
    assert "bob@" not in new["text"] and new["n_chars"] == len(new["text"])
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in final.collect()} == seen
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in final.collect()}


def test_decisions_are_about_rows(spark, sf_dir):
    other = "quite another text with words of its own that nobody else has written anywhere so far "
    third = " ".join(reversed(other.split()))
    rows = [(1, LONG, "x", 1), (2, LONG, "x", 1), (2, other, "x", 1), (2, other, "x", 1), (None, third, "y", 1), (None, third, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_no string, score bigint").withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumn("lang", F.lit("en")).withColumn("language_found", F.lit(1)).withColumn("held_out", F.lit(1)).withColumn("values_found", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in stages["near_duplicates"](spark, docs, sf_dir).collect())
    assert kept == sorted([(1, LONG), (2, other), (0, third)])
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    docs = docs.union(spark.createDataFrame([(None, item, "x", 1, 80, "en", 1, 1, 1), (1, item, "x", 1, 80, "en", 1, 1, 1)], docs.schema))
    for name in ("language", "decontamination", "private_data"):
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == docs.columns
        texts = [r["text"] for r in got.collect()]
        assert (item in texts) == (name != "decontamination") and sum(t != item for t in texts) == len(rows)


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert got.count() == 0
    assert language_id.UNDETERMINED == "und"
