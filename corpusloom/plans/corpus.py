"""Queries of row operations and text functions, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments
from ..functions import text as fn
from ..operators import rows, statistics
from .registry import query, table

#: DuckDB SQL of a text's tokens between ASCII white space.
TOKENS_SQL = "list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')"


def tokens(text: str = "text"):
    """Tokens between ASCII white space."""
    return F.filter(F.split(text, "[ \n\t\r]+"), lambda t: t != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: text_id, ref, segment."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.col("doc_id").alias("ref"), tokens().alias("segment"), "text")


DOCS_SQL = f"SELECT source AS text_id, doc_id AS ref, {TOKENS_SQL} AS segment, text FROM documents"


@query(
    "word_probability",
    f"""WITH w AS (SELECT lang, lower(unnest({TOKENS_SQL})) AS word FROM documents),
    c AS (SELECT lang, word, count(*) AS cnt FROM w GROUP BY lang, word)
    SELECT lang, word, cnt, round(cnt / sum(cnt) OVER (PARTITION BY lang), 9) AS prob FROM c""",
)
def word_probability(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(fn.lowercase(tokens())).alias("word"))
    counts = statistics.frequency(words, "lang", "word")
    return statistics.max_likelihood(counts, "lang").select("lang", "word", "cnt", F.round("prob", 9).alias("prob"))


@query("where_nonempty", f"SELECT text_id, ref, len(segment) AS n FROM ({DOCS_SQL}) WHERE len(segment) > 0")
def where_nonempty(spark, sf_dir):
    return rows.where_nonempty(documents(spark, sf_dir)).select("text_id", "ref", F.size("segment").cast("bigint").alias("n"))


@query("filter_texts", f"SELECT text_id, ref, len(segment) AS n FROM ({DOCS_SQL}) WHERE text_id IN ('src1', 'src5', 'src7')")
def filter_texts(spark, sf_dir):
    return rows.filter_texts(documents(spark, sf_dir), ["src1", "src5", "src7"]).select("text_id", "ref", F.size("segment").cast("bigint").alias("n"))


@query("exclude_texts", f"SELECT text_id, ref FROM ({DOCS_SQL}) WHERE text_id NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 6000)")
def exclude_texts(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").where("lang = 'es' and n_chars > 6000").select(F.col("source").alias("text_id"))
    return rows.exclude_texts(documents(spark, sf_dir), ids).select("text_id", "ref")


@query("take_ordered", "SELECT source AS text_id, doc_id AS ref, n_chars FROM documents ORDER BY source, doc_id LIMIT 25")
def take_ordered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.col("doc_id").alias("ref"), "n_chars")
    return rows.take(docs, 25, ["text_id", "ref"])


@query("row_index", "SELECT source AS text_id, doc_id AS ref, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index FROM documents")
def row_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.col("doc_id").alias("ref"))
    return rows.with_index(docs, ["ref"], ["text_id"]).withColumn("index", F.col("index").cast("bigint"))


@query(
    "flatten_corpora",
    "SELECT corpus_no, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 0 AS corpus_no, text FROM documents UNION ALL SELECT 1, text FROM benchmark UNION ALL SELECT 2, text FROM conversations) GROUP BY corpus_no",
)
def flatten_corpora(spark, sf_dir):
    whole = rows.flatten([table(spark, sf_dir, n).select("text") for n in ("documents", "benchmark", "conversations")])
    return whole.groupBy("corpus_no").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("split_corpus")
def split_corpus(spark, sf_dir):
    return rows.split(documents(spark, sf_dir), F.col("ref"), percent=0.1, size=1000).select("text_id", "ref", "is_split")


@query("corpus_count", f"SELECT text_id, count(*) AS all_rows, count(*) FILTER (len(segment) > 0) AS full_rows FROM ({DOCS_SQL}) GROUP BY text_id")
def corpus_count(spark, sf_dir):
    docs = documents(spark, sf_dir)
    full = rows.count(docs, include_empty=False).withColumnRenamed("n_rows", "full_rows")
    return rows.count(docs).withColumnRenamed("n_rows", "all_rows").join(full, "text_id")


@query(
    "lowercase_tokens",
    f"SELECT lang, count(*) AS n, count(DISTINCT lower(w)) AS n_lower, count(DISTINCT upper(replace(w, 'ß', 'ss'))) AS n_upper FROM (SELECT lang, unnest({TOKENS_SQL}) AS w FROM documents) GROUP BY lang",
)
def lowercase_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", tokens().alias("t"))
    both = docs.select("lang", F.explode(F.arrays_zip(fn.lowercase(F.col("t")).alias("l"), fn.uppercase(F.col("t")).alias("u"))).alias("w"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("w.l").alias("n_lower"), F.countDistinct("w.u").alias("n_upper"))


@query(
    "escape_spaces",
    "SELECT doc_id, len(list_filter(s, lambda x: regexp_full_match(x, '[ \\t\\n\\r]+'))) AS n_escaped FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[ \\t\\n\\r]+|[^ \\t\\n\\r]+'), lambda x: x <> '') AS s FROM documents)",
)
def escape_spaces(spark, sf_dir):
    pieces = fn.regex_tokens(F.col("text"), "[ \t\n\r]+|[^ \t\n\r]+")
    docs = table(spark, sf_dir, "documents").select("doc_id", fn.escape_spaces(pieces).alias("s"))
    return docs.select("doc_id", F.size(F.filter("s", lambda t: t == "<space>")).cast("bigint").alias("n_escaped"))


@query("line_segments", "SELECT doc_id, i AS line, list_extract(s, i) AS segment FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS s FROM documents))")
def line_segments(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.line_segments(F.col("text"))).alias("at", "segment"))
    return lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), "segment")


@query("sentence_ending", "SELECT doc_id, regexp_matches(text, '[.!?‼‽⁇⁈⁉。﹒﹗！．？｡][\"“”„‟''‘’‚‛«»‹›)\\]>}]*\\s*$') AS ends FROM documents")
def sentence_ending(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.has_sentence_ending(F.col("text")).alias("ends"))


@query(
    "sentence_start_flags",
    "SELECT conv_id, turn, coalesce(lag(regexp_matches(text, '[.!?‼‽⁇⁈⁉。﹒﹗！．？｡][\"“”„‟''‘’‚‛«»‹›)\\]>}]*\\s*$')) OVER (PARTITION BY conv_id ORDER BY turn), true) AS starts FROM conversations",
)
def sentence_start_flags(spark, sf_dir):
    return rows.sentence_starts(table(spark, sf_dir, "conversations"), ["turn"], "text", "conv_id").select("conv_id", "turn", "starts")


@query("capitalize", "SELECT doc_id, concat(upper(text[1:1]), text[2:]) AS capital, concat(upper(text[1:1]), lower(text[2:])) AS title FROM documents")
def capitalize(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))  # SQL's concat takes null for an empty text
    return table(spark, sf_dir, "documents").select("doc_id", fn.capitalize(text).alias("capital"), fn.to_title_case(text).alias("title"))


@query("trim_end", "SELECT doc_id, regexp_replace(text, '[. \\n\\t]+$', '') AS trimmed FROM documents")
def trim_end(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.trim_end(F.col("text"), ". \n\t").alias("trimmed"))


@query("latin_tokens")
def latin_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.latin_tokens(F.col("text"))).alias("at", "token"))


@query("latin_round_trip")
def latin_round_trip(spark, sf_dir):
    kept = fn.latin_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", segments.latin_detokenize(kept).alias("text"))


@query("sentence_case")
def sentence_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.to_sentence_case(fn.latin_tokens(F.col("text"))).alias("tokens"))


@query("whitespace_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM documents")
def whitespace_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fn.whitespace_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("quote_mark_counts", "SELECT mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\"“”„‟‘’‚‛«»‹›]')) AS mark FROM documents) GROUP BY mark")
def quote_mark_counts(spark, sf_dir):
    marks = table(spark, sf_dir, "documents").select(F.explode(fn.regex_tokens(F.col("text"), '["“”„‟‘’‚‛«»‹›]')).alias("mark"))
    return statistics.frequency(marks, "mark").withColumnRenamed("cnt", "n")
