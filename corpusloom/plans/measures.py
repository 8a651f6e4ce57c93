"""Queries of further models, measures, grouping sets, word pairs and feature structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, features, quote_resolution, statistics, word_alignment
from .corpus import tokens
from .models import BIGRAM_SQL, cond_freq_by_lang, confidences, text_tokens, word_frequency
from .registry import query, table


@query("good_turing_words", None)
def good_turing_words(spark, sf_dir):
    return statistics.good_turing_probability(word_frequency(spark, sf_dir)).select("word", "cnt", F.round("prob", 12).alias("prob"), F.round("unseen", 9).alias("unseen"))


@query(
    "log_space",
    """WITH l AS (SELECT l_orderkey, ln(l_quantity) AS a, CASE WHEN l_discount = 0 THEN -999999999.0 ELSE ln(l_discount) END AS b FROM lineitem)
    SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN b <= -999999999.0 THEN a ELSE ln(exp(a) + exp(b)) END), 6) AS added, count(*) FILTER (b <= -999999999.0) AS zeros, round(sum(CASE WHEN b <= -999999999.0 THEN 0 ELSE a + b END), 6) AS product FROM l GROUP BY l_orderkey""",
)
def log_space(spark, sf_dir):
    a, b = F.ln("l_quantity"), F.when(F.col("l_discount") == 0, F.lit(statistics.LOG_ZERO)).otherwise(F.ln("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", statistics.log_add(a, b).alias("s"), statistics.log_multiply(a, b).alias("p"))
    zero = F.col("p") <= statistics.LOG_ZERO
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("s"), 6).alias("added"), F.count_if(zero).alias("zeros"), F.round(F.sum(F.when(zero, 0.0).otherwise(F.col("p"))), 6).alias("product"))


@query("ngram_counts_reversed", f"{BIGRAM_SQL} SELECT t[i + 1] AS context, t[i] AS word, count(*) AS cnt FROM (SELECT t, unnest(range(1, len(t))) AS i FROM b) GROUP BY ALL")
def ngram_counts_reversed(spark, sf_dir):
    return statistics.ngram_counts(text_tokens(spark, sf_dir), 2, right_to_left=True).select(F.col("context")[0].alias("context"), "word", "cnt")


TRIGRAM_SQL = f"""{BIGRAM_SQL}, u2 AS (SELECT context, g.word AS word, (g.cnt + k * p.prob) / (n + k) AS prob FROM g JOIN c USING (context) JOIN p ON g.word = p.word),
g3 AS (SELECT t[i] AS x, t[i + 1] AS y, t[i + 2] AS word, count(*) AS cnt FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM b) GROUP BY ALL), c3 AS (SELECT x, y, sum(cnt) AS n, count(*) AS k FROM g3 GROUP BY x, y)
SELECT g3.x AS x, g3.y AS y, g3.word AS word, round((g3.cnt + c3.k * u2.prob) / (c3.n + c3.k), 9) AS prob FROM g3 JOIN c3 ON g3.x = c3.x AND g3.y = c3.y JOIN u2 ON u2.context = g3.y AND u2.word = g3.word"""


@query("trigram_witten_bell", TRIGRAM_SQL)
def trigram_witten_bell(spark, sf_dir):
    out = statistics.train_all(text_tokens(spark, sf_dir), 3, statistics.ngram_witten_bell)[-1]
    return out.select(F.col("context")[0].alias("x"), F.col("context")[1].alias("y"), "word", F.round("prob", 9).alias("prob"))


@query("conditional_probability", None)
def conditional_probability(spark, sf_dir):
    return statistics.max_likelihood(cond_freq_by_lang(spark, sf_dir), "lang").select("lang", "start", F.round("prob", 9).alias("prob"))


@query("low_confidence", "SELECT event_id, (abs(value) / (1 + abs(value))) < 0.42 AS low FROM events WHERE value IS NOT NULL")
def low_confidence(spark, sf_dir):
    return confidences(spark, sf_dir).select("event_id", evaluation.low_confidence(F.col("confidence")).alias("low"))


@query("word_cube", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def word_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("word_rollup", "SELECT lang, source, count(DISTINCT text) AS texts FROM documents GROUP BY ROLLUP (lang, source)")
def word_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.countDistinct("text").alias("texts"))


@query("suggestion_metrics", "SELECT round(sum(l_linenumber) / sum(l_quantity), 9) AS ksmr, round(sum(l_linenumber % 3) / sum(l_linenumber), 9) AS precision, round(sum(l_linenumber % 2) / sum(l_linenumber % 3), 9) AS full_share FROM lineitem")
def suggestion_metrics(spark, sf_dir):
    """Sums of made-up segments: a line item is one."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(n.alias("actions"), F.col("l_quantity").alias("characters"), n.alias("suggestions"), (n % 3).alias("accepted"), (n % 2).alias("full"), *[F.lit(0).alias(c) for c in ("initial", "final", "middle")])
    out = evaluation.suggestion_metrics(rows)
    return out.select(*[F.round(c, 9).alias(c) for c in ("ksmr", "precision", "full_share")])


def _pairs(spark, sf_dir):
    """Pairs of two directions by order: line numbers, and what they are in reverse."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seg"), (F.col("l_linenumber") - 1).cast("int").alias("i"), F.pmod(F.col("l_partkey"), F.lit(5)).cast("int").alias("j"), "l_quantity")
    of = lambda rows, name: rows.groupBy("seg").agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias(name))
    return of(lines.where("l_quantity > 10"), "direct").join(of(lines.where("l_quantity < 40"), "inverse"), "seg")


PAIRS_SQL = """WITH l AS (SELECT l_orderkey AS seg, l_linenumber - 1 AS i, l_partkey % 5 AS j, l_quantity AS q FROM lineitem),
d AS (SELECT DISTINCT seg, i, j FROM l WHERE q > 10), v AS (SELECT DISTINCT seg, i, j FROM l WHERE q < 40), k AS (SELECT DISTINCT seg FROM d INTERSECT SELECT seg FROM v)"""
JOINED = "string_agg(i || '-' || j, ' ' ORDER BY i, j)"


@query("alignment_union", f"{PAIRS_SQL} SELECT seg, {JOINED} AS pairs FROM (SELECT * FROM d UNION SELECT * FROM v) JOIN k USING (seg) GROUP BY seg")
def alignment_union(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seg", word_alignment.to_pharaoh(word_alignment.union(F.col("direct"), F.col("inverse"))).alias("pairs"))


@query("alignment_intersection", f"{PAIRS_SQL} SELECT k.seg AS seg, coalesce({JOINED}, '') AS pairs FROM k LEFT JOIN (SELECT * FROM d INTERSECT SELECT * FROM v) x ON x.seg = k.seg GROUP BY k.seg".replace("i || '-' || j", "x.i || '-' || x.j").replace("ORDER BY i, j", "ORDER BY x.i, x.j"))
def alignment_intersection(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seg", word_alignment.to_pharaoh(word_alignment.intersection(F.col("direct"), F.col("inverse"))).alias("pairs"))


@query("alignment_transpose", f"{PAIRS_SQL} SELECT seg, string_agg(j || '-' || i, ' ' ORDER BY j, i) AS pairs FROM d JOIN k USING (seg) GROUP BY seg")
def alignment_transpose(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seg", word_alignment.to_pharaoh(word_alignment.transpose(F.col("direct"))).alias("pairs"))


@query("alignment_rows", f"{PAIRS_SQL} SELECT seg, count(DISTINCT i) FILTER (i < 3) AS n_rows, bool_or(j = 2) AS column_two, coalesce(count(*) FILTER (i < 2 AND j < 3), 0) AS n_within FROM d JOIN k USING (seg) GROUP BY seg")
def alignment_rows(spark, sf_dir):
    p = F.col("direct")
    n = sum((word_alignment.row_aligned(p, F.lit(i)).cast("bigint") for i in range(1, 3)), word_alignment.row_aligned(p, F.lit(0)).cast("bigint"))
    return _pairs(spark, sf_dir).select("seg", n.alias("n_rows"), word_alignment.column_aligned(p, F.lit(2)).alias("column_two"), F.size(word_alignment.resize(p, F.lit(2), F.lit(3))).cast("bigint").alias("n_within"))


@query("symmetrize_priority")
def symmetrize_priority(spark, sf_dir):
    out = word_alignment.symmetrize_rows(_pairs(spark, sf_dir), "priority")
    return out.select("seg", word_alignment.to_pharaoh(F.col("pairs")).alias("pairs"))


@query("known_alignments", f"{PAIRS_SQL}, e AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.seg = d.seg AND (v.i = d.i OR v.j = d.j))) SELECT seg, {JOINED} AS pairs FROM (SELECT * FROM v UNION ALL SELECT * FROM e) JOIN k USING (seg) GROUP BY seg")
def known_alignments(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seg", word_alignment.to_pharaoh(word_alignment.merge_known(F.col("direct"), F.col("inverse"))).alias("pairs"))


@query("giza_lines")
def giza_lines(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("seg", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("w"), "direct")
    return rows.select("seg", word_alignment.to_giza(F.col("seg"), F.col("w"), F.slice("w", 1, 5), F.col("direct")).alias("lines"))


@query(
    "symmetrized_table",
    """WITH a AS (SELECT DISTINCT l_suppkey AS src, l_linenumber AS trg, l_linenumber / 10 AS p FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS src, l_linenumber AS trg, 1 - l_linenumber / 10 AS p FROM lineitem WHERE l_quantity > 25)
    SELECT src, trg, round(greatest(coalesce(a.p, 0), coalesce(b.p, 0)), 9) AS prob FROM a FULL JOIN b USING (src, trg)""",
)
def symmetrized_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("trg")).distinct().withColumn("prob", F.col("trg") / 10)
    b = lines.where("l_quantity > 25").select(F.col("l_linenumber").alias("src"), F.col("l_suppkey").alias("trg")).distinct().withColumn("prob", 1 - F.col("src") / 10)
    return word_alignment.symmetrized_table(a, b).withColumn("prob", F.round("prob", 9))


@query(
    "top_translations",
    "SELECT src, trg, round(prob, 9) AS prob, rank FROM (SELECT src, trg, prob, row_number() OVER (PARTITION BY src ORDER BY prob DESC, trg) AS rank FROM (SELECT src, trg, n / sum(n) OVER (PARTITION BY src) AS prob FROM (SELECT l_returnflag AS src, l_suppkey::VARCHAR AS trg, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE prob > 0.0001) WHERE rank <= 5",
)
def top_translations(spark, sf_dir):
    counts = statistics.frequency(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("src"), F.col("l_suppkey").cast("string").alias("trg")), "src", "trg")
    out = word_alignment.translations(statistics.max_likelihood(counts, "src"), 0.0001, 5)
    return out.select("src", "trg", F.round("prob", 9).alias("prob"), F.col("rank").cast("bigint").alias("rank"))


@query("feature_unify", "SELECT event_id, CASE WHEN ((event_id % 7 + 1) & (user_id % 7 + 1)) <> 0 THEN (event_id % 7 + 1) & (user_id % 7 + 1) END AS t, user_id % 7 + 1 AS first FROM events")
def feature_unify(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("t"), F.col("event_id") % 7 + 1).alias("a"), F.create_map(F.lit("t"), F.col("user_id") % 7 + 1).alias("b"))
    unified, united = features.unify(F.col("a"), F.col("b")), features.priority_union(F.col("a"), F.col("b"))
    return rows.select("event_id", F.try_element_at(unified, F.lit("t")).alias("t"), F.try_element_at(united, F.lit("t")).alias("first"))


@query("token_vocabulary", "SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY ALL) ORDER BY rank LIMIT 500")
def token_vocabulary(spark, sf_dir):
    """A report of the 500 commonest words."""
    from pyspark.sql import Window

    words = statistics.frequency(table(spark, sf_dir, "benchmark").select(F.explode(F.transform(tokens(), F.lower)).alias("word")), "word").withColumnRenamed("cnt", "n")
    top = words.orderBy(F.desc("n"), "word").limit(500)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("bigint"))


@query(
    "feature_operations",
    """WITH e AS (SELECT event_id, event_id % 7 + 1 AS a, user_id % 7 + 1 AS b FROM events)
    SELECT event_id, a | b AS united, a | b AS added, nullif(a & ~b, 0) AS subtracted FROM e""",
)
def feature_operations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("t"), F.col("event_id") % 7 + 1).alias("a"), F.create_map(F.lit("t"), F.col("user_id") % 7 + 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    made = {"united": features.union(a, b), "added": features.add(a, b), "subtracted": features.subtract(a, b)}
    return rows.select("event_id", *[F.try_element_at(c, F.lit("t")).alias(n) for n, c in made.items()])


@query("quote_resolved")
def quote_resolved(spark, sf_dir):
    return quote_resolution.resolved(table(spark, sf_dir, "documents"), ["doc_id"], "typewriter_english")


@query("quote_detected")
def quote_detected(spark, sf_dir):
    return quote_resolution.detect(table(spark, sf_dir, "documents"), ["source"])
