"""A training-data pipeline over `documents`, one stage for each decision about a document.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame.
All but the last return the columns of docs. Decisions are about rows, which have a number of their own
within a stage: rows with equal or null ids are judged one by one, and columns of any name may go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, language_id, near_dedup, pii, sentencepiece_codec
from corpusloom.llm.common import bounded, stash, table
from corpusloom.llm.vocab import tokenizer_path

#: Documents are rejected if their language is undetermined or scores less than so many even shares.
MIN_LANGUAGE_SHARES = 1.2


def _unused(docs: DataFrame, name: str) -> str:
    """That name, or the first with a number that docs has no column of (names differ by more than case)."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n not in taken)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs at rest with a number for each row, and the name of its column."""
    row = _unused(docs, "row_no")
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """rows without those of the given numbers, which are broadcast only if they are few; without the number."""
    return rows.join(bounded(stash(gone.select(F.col(gone.columns[0]).alias(row)), "rejected")), row, "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that can be told."""
    model, found = language_id.learn(docs), _unused(docs, "language_found")
    known = language_id.annotate(docs, model, found)
    least = MIN_LANGUAGE_SHARES / max(2, len(model.languages))
    kept = (F.col(found)["lang_pred"] != language_id.UNDETERMINED) & (F.col(found)["score"] >= least)
    return known.where(kept).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that of the least doc_id, and of equal ids the first."""
    rows, row = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = near_dedup.near_duplicates(rows.select(key.alias("doc_id"), "text"), k=4, percent=80)
    return _without(rows, row, found.where(~F.col("kept")).select("doc_id.row")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold much of the benchmark."""
    rows, row = _numbered(docs)
    found = decontamination.contamination(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, row, found.where("contaminated").select("doc_id")).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal data; n_chars follows the new text."""
    count = _unused(docs, "values_found")
    new = pii.pseudonymize(docs, pii.session_key(spark), count=count)
    return new.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return sentencepiece_codec.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("private_data", private_data),
    ("sentencepiece", tokens),
]

#: Language models, sketches and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
