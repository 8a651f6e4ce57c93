"""Queries of row sets, token functions and tokens with a state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segments
from ..functions import text as fn
from ..operators import joins, quotations, rows, sequences
from .corpus import DOCS_SQL, TOKENS_SQL, documents, tokens
from .joins import SIDES_SQL, sides
from .registry import query, table

long = lambda c: F.col(c).cast("bigint").alias(c)


@query("normalize_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.normalize(F.col("text"), "NFC").alias("text"))


@query("normalize_nfkd")
def normalize_nfkd(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.normalize(F.col("text"), "NFKD").alias("text"))


@query("batches", "SELECT text_id, ref // 1 AS ref, (row_number() OVER (PARTITION BY text_id ORDER BY ref) - 1) // 64 AS batch FROM (SELECT source AS text_id, doc_id AS ref FROM documents)")
def batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.col("doc_id").alias("ref"))
    return rows.batches(docs, 64, ["ref"], ["text_id"])


ZIP_SQL = """WITH o AS (SELECT o_custkey AS text_id, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
c AS (SELECT conv_id AS text_id, turn AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
SELECT text_id, place, o.ref AS one, c.ref AS two FROM o JOIN c USING (text_id, place)"""


@query("zip_many", ZIP_SQL)
def zip_many(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("text_id"), F.col("o_orderkey").alias("ref"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("text_id"), F.col("turn").alias("ref"))
    out = rows.zip_many([orders, turns], ["ref"], ["text_id"])
    return out.select("text_id", long("place"), F.col("r0.ref").alias("one"), F.col("r1.ref").alias("two"))


@query("common_texts", "SELECT DISTINCT source AS text_id FROM documents WHERE lang = 'de' AND n_chars > 9000 INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def common_texts(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("n", F.length("text"))
    of = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("text_id"), "n_chars")
    return rows.common_texts([of.where("lang = 'de' and n_chars > 9000"), of.where("lang = 'fr'"), docs])


@query("all_texts", "SELECT DISTINCT source AS text_id FROM documents WHERE lang = 'de' UNION SELECT role FROM conversations")
def all_texts(spark, sf_dir):
    of = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("text_id"))
    return rows.all_texts([of, table(spark, sf_dir, "conversations").select(F.col("role").alias("text_id"))])


@query("except_refs", f"{SIDES_SQL} SELECT text_id, ref FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.text_id = s.text_id AND t.ref = s.ref)")
def except_refs(spark, sf_dir):
    return rows.except_refs(*sides(spark, sf_dir)).select("text_id", "ref")


@query("transform_rows", f"SELECT text_id, ref, array_to_string(list_transform(segment, lambda x: lower(x)), ' ') AS text FROM ({DOCS_SQL})")
def transform_rows(spark, sf_dir):
    out = rows.transform(documents(spark, sf_dir), fn.escape_spaces, fn.unescape_spaces, fn.lowercase)
    return out.select("text_id", "ref", segments.whitespace_detokenize(F.col("segment")).alias("text"))


@query("attach_alignments", f"{SIDES_SQL} SELECT text_id, ref, CASE WHEN len(s.segment) > 0 AND len(t.segment) > 0 AND ref % 3 = 0 THEN 1 ELSE 0 END AS n_pairs FROM s JOIN t USING (text_id, ref)")
def attach_alignments(spark, sf_dir):
    source, target = sides(spark, sf_dir)
    found = source.where("ref % 3 = 0").select("text_id", "ref", F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))).alias("pairs"))
    out = joins.attach_alignments(joins.align_rows(source, target), found)
    return out.select("text_id", "ref", F.coalesce(F.size("pairs"), F.lit(0)).alias("n_pairs"))


@query("null_tokens", "SELECT doc_id, 1 AS n, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def null_tokens(spark, sf_dir):
    out = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.null_tokens(F.col("text")).alias("t"))
    return out.select("doc_id", F.size("t").alias("n"), F.length(F.col("t")[0]).cast("bigint").alias("chars"))


ZWSP_SQL = "list_filter(list_transform(string_split(replace(text, ' ', chr(8203)), chr(8203)), lambda x: trim(x)), lambda x: x <> '')"


@query("zwsp_tokens", f"SELECT doc_id, len({ZWSP_SQL}) AS n FROM documents")
def zwsp_tokens(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(" "), F.lit("​"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fn.zwsp_words(text)).cast("bigint").alias("n"))


@query("zwsp_word_tokens")
def zwsp_word_tokens(spark, sf_dir):
    """Tokens of texts whose single spaces within lines have become zero-width ones; other white space is tokens."""
    text = F.regexp_replace("text", r"(?<=\S) (?=\S)", "\u200b")
    return table(spark, sf_dir, "documents").select("doc_id", fn.zwsp_tokens(text).alias("tokens"))


@query("zwsp_detokenize")
def zwsp_detokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.zwsp_detokenize(fn.latin_tokens(F.col("text"))).alias("text"))


@query("whitespace_detokenize", f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS text FROM documents")
def whitespace_detokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.whitespace_detokenize(tokens()).alias("text"))


@query("latin_sentences")
def latin_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segments.sentences(F.col("text"))).alias("at", "sentence"))


@query("latin_ranges")
def latin_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "documents").select("doc_id", F.explode(segments.latin_ranges(F.col("text"))).alias("r"))
    return ranges.select("doc_id", "r.start", "r.end")


CASES_SQL = f"SELECT word, regexp_full_match(word, '[a-z]+') AS lower, regexp_full_match(word, '[A-Z][a-z]*') AS title, regexp_full_match(word, '[.!?]+') AS terminal FROM (SELECT DISTINCT unnest({TOKENS_SQL}) AS word FROM benchmark) WHERE regexp_full_match(word, '[ -~]+')"


@query("token_cases", CASES_SQL)
def token_cases(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens()).alias("word")).distinct().where(F.col("word").rlike("^[ -~]+$"))
    return words.select("word", fn.is_lower(F.col("word")).alias("lower"), fn.is_title_case(F.col("word")).alias("title"), fn.is_sentence_terminal(F.col("word")).alias("terminal"))


MARK_SQL = """WITH t AS (SELECT doc_id, string_split_regex(text, '<<|>>|["“”„‟''‘’‚‛«»‹›]') AS p, regexp_extract_all(text, '<<|>>|["“”„‟''‘’‚‛«»‹›]') AS m FROM documents),
e AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS k FROM t)
SELECT doc_id, k - 1 AS k, m[k] AS mark, CASE WHEN p[k] <> '' THEN right(p[k], 1) WHEN k > 1 THEN right(m[k - 1], 1) ELSE '' END AS before, CASE WHEN p[k + 1] <> '' THEN left(p[k + 1], 1) ELSE coalesce(left(m[k + 1], 1), '') END AS after FROM e"""


@query("quote_contexts", MARK_SQL)
def quote_contexts(spark, sf_dir):
    return quotations.marks_in_context(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", long("k"), "mark", "before", "after")


@query("word_distances")
def word_distances(spark, sf_dir):
    """Words by which an answer differs from what was said before."""
    source, target = sides(spark, sf_dir)
    both = joins.align_rows(source, target).select("text_id", "ref", "source_segment", "target_segment")
    return sequences.distances(both, "source_segment", "target_segment").select("text_id", "ref", "distance", "prefix_distance")


@query("part_distances", "SELECT a.p_partkey AS p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def part_distances(spark, sf_dir):
    """Distances of sequences, here of letters."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("a"))
    both = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return sequences.distances(both, "a", "b").select("p_partkey", "distance")


@query("sequence_alignment")
def sequence_alignment(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    both = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return sequences.aligned(both, "a", "b", "semi-global").select("p_partkey", "score", "columns")
