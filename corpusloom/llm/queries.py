"""One query for each text operator, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vocab import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination, digests

    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize, session_key

    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count="n_values")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op13_exact_dedup", EXACT_DEDUP)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op11_vector_codes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
