"""Queries of corpus alignment, over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, rows
from .corpus import TOKENS_SQL, tokens
from .registry import query, table


def sides(spark, sf_dir):
    """User turns and the turns after them, by conversation and a turn's number among its pairs."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("text_id"), "turn", "role", tokens().alias("segment"))
    source = turns.where("role = 'user'").select("text_id", F.col("turn").alias("ref"), "segment")
    target = turns.where("role = 'assistant'").select("text_id", (F.col("turn") - 1).alias("ref"), "segment")
    return source, target


SIDES_SQL = f"""WITH s AS (SELECT conv_id AS text_id, turn AS ref, {TOKENS_SQL} AS segment FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id AS text_id, turn - 1 AS ref, {TOKENS_SQL} AS segment FROM conversations WHERE role = 'assistant')"""


def _register(name: str, how: str, all_source: bool, all_target: bool) -> None:
    sql = f"{SIDES_SQL} SELECT text_id, ref, coalesce(len(s.segment), 0) AS n_source, coalesce(len(t.segment), 0) AS n_target FROM s {how} JOIN t USING (text_id, ref)"

    @query(name, sql)
    def run(spark, sf_dir):
        out = joins.align_rows(*sides(spark, sf_dir), all_source, all_target)
        return out.select("text_id", "ref", F.size("source_segment").cast("bigint").alias("n_source"), F.size("target_segment").cast("bigint").alias("n_target"))


_register("align_rows_inner", "", False, False)
_register("align_rows_all_source", "LEFT", True, False)
_register("align_rows_all_target", "RIGHT", False, True)
_register("align_rows_full", "FULL", True, True)


def four(spark, sf_dir):
    """documents as four corpora by language, in the order of their names, the fifth going with the first and so on, documents without
    one last: the text is the source, references number its documents."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("text_id"), "doc_id", tokens().alias("segment"))
    langs = docs.select(F.col("lang").alias("l")).distinct().withColumn("corpus", F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("l"))) - 1, F.lit(4)))
    docs = docs.join(langs, F.col("lang").eqNullSafe(F.col("l"))).drop("lang", "l")
    docs = rows.with_index(docs, ["doc_id"], ["corpus", "text_id"], "ref")
    return [docs.where(F.col("corpus") == i).select("text_id", "ref", "segment") for i in range(4)]


FOUR_SQL = f"""WITH l AS (SELECT lang, (row_number() OVER (ORDER BY lang NULLS LAST) - 1) % 4 AS corpus FROM (SELECT DISTINCT lang FROM documents)),
d AS (SELECT corpus, source AS text_id, row_number() OVER (PARTITION BY corpus, source ORDER BY doc_id) - 1 AS ref, len({TOKENS_SQL}) AS n FROM documents JOIN l ON documents.lang IS NOT DISTINCT FROM l.lang),
p AS (SELECT text_id, ref, {", ".join(f"max(n) FILTER (corpus = {i}) AS n{i}" for i in range(4))} FROM d GROUP BY ALL)"""


@query("align_many", f"{FOUR_SQL} SELECT text_id, ref, {', '.join(f'coalesce(n{i}, 0) AS n{i}' for i in range(4))} FROM p WHERE n0 IS NOT NULL OR n2 IS NOT NULL")
def align_many(spark, sf_dir):
    out = joins.align_many(four(spark, sf_dir), [True, False, True, False])
    return out.select("text_id", F.col("ref").cast("bigint").alias("ref"), *[F.size(F.col("segments")[i]).cast("bigint").alias(f"n{i}") for i in range(4)])


@query("align_many_inner", f"{FOUR_SQL} SELECT text_id, ref, n0, n1, n2, n3 FROM p WHERE n0 IS NOT NULL AND n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL")
def align_many_inner(spark, sf_dir):
    out = joins.align_many(four(spark, sf_dir), [False] * 4)
    return out.select("text_id", F.col("ref").cast("bigint").alias("ref"), *[F.size(F.col("segments")[i]).cast("bigint").alias(f"n{i}") for i in range(4)])


TRIPLE_SQL = """WITH t AS (SELECT conv_id AS text_id, turn // 4 AS ref, turn % 3 AS corpus, length(text) AS n FROM conversations)
SELECT coalesce(a.text_id, b.text_id, c.text_id) AS text_id, coalesce(a.ref, b.ref, c.ref) AS ref, coalesce(a.n, 0) AS n0, coalesce(b.n, 0) AS n1, coalesce(c.n, 0) AS n2
FROM (SELECT * FROM t WHERE corpus = 0) a FULL JOIN (SELECT * FROM t WHERE corpus = 1) b ON a.text_id = b.text_id AND a.ref = b.ref
FULL JOIN (SELECT * FROM t WHERE corpus = 2) c ON coalesce(a.text_id, b.text_id) = c.text_id AND coalesce(a.ref, b.ref) = c.ref"""


@query("align_many_duplicates", TRIPLE_SQL)
def align_many_duplicates(spark, sf_dir):
    """References that repeat in a corpus: their rows meet in all ways."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("text_id"), F.floor(F.col("turn") / 4).cast("bigint").alias("ref"), "turn", F.array("text").alias("segment"))
    corpora = [turns.where(F.col("turn") % 3 == i).drop("turn") for i in range(3)]
    size = lambda i: F.coalesce(F.length(F.get(F.col("segments")[i], F.lit(0))), F.lit(0)).cast("bigint").alias(f"n{i}")
    return joins.align_many(corpora, [True] * 3).select("text_id", "ref", *[size(i) for i in range(3)])


@query("choose_first", f"{FOUR_SQL} SELECT text_id, ref, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 WHEN n3 > 0 THEN 3 ELSE -1 END AS corpus_no, CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 ELSE 0 END AS n FROM p")
def choose_first(spark, sf_dir):
    return joins.choose_first(four(spark, sf_dir)).select("text_id", F.col("ref").cast("bigint").alias("ref"), "corpus_no", F.size("segment").cast("bigint").alias("n"))


@query("choose_random")
def choose_random(spark, sf_dir):
    return joins.choose_random(four(spark, sf_dir), 1234).select("text_id", "ref", "corpus_no", F.size("segment").alias("n"))


@query(
    "range_islands",
    """WITH r AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS starts FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT conv_id, island::BIGINT AS island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM g GROUP BY conv_id, island""",
)
def range_islands(spark, sf_dir):
    turns = rows.islands(table(spark, sf_dir, "conversations"), "role", ["turn"], "conv_id")
    return turns.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("align_ranges")
def align_ranges(spark, sf_dir):
    flags = lambda even: F.when(F.pmod(F.col("ref"), F.lit(4)) < 2, F.lit(3) + F.when(F.pmod(F.col("ref"), F.lit(2)) == 0, 4).otherwise(0)).otherwise(1) if even else F.lit(1)
    source, target = sides(spark, sf_dir)
    out = joins.align_ranges(source.withColumn("flags", flags(True)), target.withColumn("flags", flags(False)))
    return out.select("text_id", "ref", "source_refs", "target_refs", F.size("source_segment").alias("n_source"), F.size("target_segment").alias("n_target"))


@query(
    "merge_duplicates",
    f"SELECT source AS text_id, doc_id // 3 AS ref, sum(len({TOKENS_SQL}))::BIGINT AS n, md5(string_agg(array_to_string({TOKENS_SQL}, ' '), ' ' ORDER BY doc_id)) AS words FROM documents GROUP BY ALL",
)
def merge_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.floor(F.col("doc_id") / 3).cast("bigint").alias("ref"), "doc_id", tokens().alias("segment"))
    out = joins.merge_duplicates(docs, ["doc_id"])
    return out.select("text_id", "ref", F.size("segment").cast("bigint").alias("n"), F.md5(F.array_join("segment", " ").cast("binary")).alias("words"))


@query(
    "corpus_stats",
    f"{SIDES_SQL} SELECT count(*) AS n_segments, sum(len(s.segment))::BIGINT AS source_words, sum(len(t.segment))::BIGINT AS target_words, round(avg(len(s.segment)), 6) AS source_mean, round(avg(len(t.segment)), 6) AS target_mean, count(*) FILTER (len(s.segment) > 200 OR len(t.segment) > 200) AS n_long FROM s JOIN t USING (text_id, ref)",
)
def corpus_stats(spark, sf_dir):
    return rows.corpus_stats(joins.align_rows(*sides(spark, sf_dir)))


@query("invert_parallel", f"{SIDES_SQL} SELECT text_id, ref, len(t.segment) AS n_source, len(s.segment) AS n_target FROM s JOIN t USING (text_id, ref)")
def invert_parallel(spark, sf_dir):
    out = rows.invert(joins.align_rows(*sides(spark, sf_dir)))
    return out.select("text_id", "ref", F.size("source_segment").cast("bigint").alias("n_source"), F.size("target_segment").cast("bigint").alias("n_target"))
