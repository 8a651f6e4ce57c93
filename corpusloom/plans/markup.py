"""Queries of versifications, marked-up texts and marks placed by alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, placement, versification
from ..sources import usfm
from .joins import SIDES_SQL, sides
from .registry import query, table


def mappings(spark, sf_dir):
    """Mappings of verses, one for each order: two verses that are one, six that shift, one that is two."""
    of = F.pmod("o_orderkey", F.lit(3))
    first, last, to_first, to_end = (F.when(of == 0, a).when(of == 1, b).otherwise(c) for a, b, c in ((1, 1, 3), (2, 6, 3), (1, 2, 3), (1, 7, 4)))
    one = F.lit(1)
    return versification.mapped(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), one.alias("chapter"), first.alias("first"), last.alias("last"), F.col("o_orderkey").alias("to_book"), one.alias("to_chapter"), to_first.alias("to_first"), to_end.alias("to_end")))


def verses(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.lit("t").alias("text_id"), F.col("l_orderkey").alias("book"), F.lit(1).alias("chapter"), F.col("l_linenumber").cast("int").alias("verse"), F.array("l_returnflag").alias("segment"), F.lit(1).alias("flags"))
    return lines


MAPPED_SQL = """WITH v AS (SELECT l_orderkey AS book, l_linenumber AS verse, l_returnflag AS w, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber <= 2 THEN 1 WHEN l_orderkey % 3 = 1 AND l_linenumber <= 6 THEN l_linenumber + 1 ELSE l_linenumber END AS r FROM lineitem),
l AS (SELECT *, CASE WHEN book % 3 = 2 AND verse = 3 THEN 4 ELSE r END AS z FROM v), e AS (SELECT *, unnest(range(r, z + 1)) AS ref FROM l),
f AS (SELECT *, CASE WHEN ref > r THEN 2 WHEN z > r THEN 7 ELSE 1 END AS f, row_number() OVER g - 1 AS place, count(*) OVER (PARTITION BY book, ref) AS n FROM e WINDOW g AS (PARTITION BY book, ref ORDER BY verse)),
w AS (SELECT book, ref, string_agg(w, ' ' ORDER BY verse, w) FILTER (ref = r) AS words FROM e GROUP BY ALL)
SELECT book, ref::INT AS ref_verse, verse::INT AS verse, place::INT AS place, CASE WHEN place = 0 THEN coalesce(words, '') ELSE '' END AS words, (CASE WHEN n = 1 THEN f WHEN place > 0 THEN 2 WHEN f = 2 THEN 2 ELSE 7 END)::INT AS flags FROM f JOIN w USING (book, ref)"""


@query("versification_ranges", MAPPED_SQL)
def versification_ranges(spark, sf_dir):
    """Verses of line items taken to another numbering; those that come to one verse are a range."""
    out = versification.with_ranges(versification.convert(verses(spark, sf_dir), mappings(spark, sf_dir), None), ["verse"])
    return out.select("book", "ref_verse", "verse", "place", F.array_join("segment", " ").alias("words"), "flags")


@query(
    "versification_back",
    """SELECT l_orderkey AS book, l_linenumber::INT AS verse, (CASE l_orderkey % 3 WHEN 0 THEN l_linenumber WHEN 1 THEN CASE WHEN l_linenumber >= 2 THEN l_linenumber - 1 ELSE 1 END ELSE CASE WHEN l_linenumber = 4 THEN 3 ELSE l_linenumber END END)::INT AS ref_verse,
    (CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 2 WHEN l_orderkey % 3 = 1 AND l_linenumber >= 2 THEN l_linenumber - 1 WHEN l_orderkey % 3 = 2 AND l_linenumber = 4 THEN 3 ELSE l_linenumber END)::INT AS ref_last FROM lineitem""",
)
def versification_back(spark, sf_dir):
    """Verses of the standard numbering in the other one: two mapped to one are a range again."""
    return versification.convert(verses(spark, sf_dir), None, mappings(spark, sf_dir)).select("book", "verse", "ref_verse", "ref_last")


STYLES = "id paragraph other|c paragraph other|v character versetext|s paragraph section|p paragraph versetext|nd character versetext|f note notetext|ft character notetext"


def styles(spark):
    return spark.createDataFrame([(m, k, t, "") for m, k, t in (x.split() for x in STYLES.split("|"))], "marker string, kind string, text_type string, end_marker string")


CLEAN_SQL = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"


@query(
    "usfm_rows",
    f"""WITH t AS (SELECT conv_id, turn, role, (turn // 4 + 1)::VARCHAR AS chapter, (turn % 4 + 1)::VARCHAR AS verse, trim(role || ' ' || {CLEAN_SQL}) AS words FROM conversations)
    SELECT conv_id, chapter, verse, 'verse' AS kind, '' AS path, words AS text FROM t UNION ALL SELECT conv_id, chapter, verse, 'note', '1:f', role || turn FROM t
    UNION ALL SELECT conv_id, chapter, '0', 'text', '1:s', role FROM t WHERE turn % 4 = 0""",
)
def usfm_rows(spark, sf_dir):
    """Conversations as marked-up books of four verses a chapter, each with a heading, a character style and a note, read back."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    verse = F.concat(F.lit("\\v "), (F.col("turn") % 4 + 1).cast("string"), F.lit(" \\nd "), "role", F.lit("\\nd* "), words, F.lit("\\f + \\ft "), "role", F.col("turn").cast("string"), F.lit("\\f*"))
    head = F.array(F.concat(F.lit("\\c "), F.floor(F.col("turn") / 4 + 1).cast("string")), F.concat(F.lit("\\s "), "role"), F.lit("\\p"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.when(F.col("turn") % 4 == 0, F.concat(head, F.array(verse))).otherwise(F.array(verse))).alias("n", "value"))
    lines = lines.select(F.col("conv_id").cast("string").alias("text_id"), F.floor(F.col("turn") / 64).alias("block"), (F.col("turn") * 4 + F.col("n")).cast("bigint").alias("line"), "value")
    rows = usfm.text_rows(usfm.parse(usfm.sections(usfm.tokens(lines)), styles(spark)), all_text=True)
    return rows.select(F.col("text_id").cast("bigint").alias("conv_id"), "chapter", "verse", "kind", "path", "text")


#: Turns and answers, their equal words aligned, and a mark in the middle of each turn.
PLACE_SQL = f"""{SIDES_SQL}, b AS (SELECT text_id, ref, s.segment AS a, t.segment AS b, len(s.segment) // 2 AS mark FROM s JOIN t USING (text_id, ref)),
i AS (SELECT text_id, ref, unnest(a) AS w, unnest(range(len(a))) AS i FROM b), j AS (SELECT text_id, ref, unnest(b) AS w, unnest(range(len(b))) AS j FROM b),
p AS (SELECT text_id, ref, i, j, w FROM i JOIN j USING (text_id, ref, w)),
q AS (SELECT text_id, ref, max(j) FILTER (i = mark - 1) + 1 AS l, min(j) FILTER (i = mark) AS r FROM p JOIN b USING (text_id, ref) WHERE NOT regexp_matches(w, '\\p{{L}}') GROUP BY ALL),
c AS (SELECT text_id, ref, t, count(*) FILTER ((i < mark) <> (j < t)) AS n FROM (SELECT text_id, ref, mark, unnest(range(len(b) + 1)) AS t FROM b) JOIN p USING (text_id, ref) GROUP BY ALL),
m AS (SELECT text_id, ref, max(t) AS t FROM (SELECT *, min(n) OVER (PARTITION BY text_id, ref) AS least FROM c) WHERE n = least GROUP BY ALL)
SELECT text_id, ref, mark::INT AS mark, coalesce(l, r, t, len(b))::INT AS place FROM b LEFT JOIN q USING (text_id, ref) LEFT JOIN m USING (text_id, ref)"""


@query("place_marks", PLACE_SQL)
def place_marks(spark, sf_dir):
    """A mark in the middle of each turn, placed in the answer by the words that both have."""
    both = joins.align_rows(*sides(spark, sf_dir))
    same = F.flatten(F.transform("source_segment", lambda w, i: F.transform(F.filter(F.transform("target_segment", lambda v, j: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))), lambda x: x["v"] == w), lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))))
    marks = F.array(F.struct(F.lit("nd").alias("name"), F.lit("style").alias("kind"), F.floor(F.size("source_segment") / 2).cast("int").alias("at")))
    out = placement.place_marks(both.withColumns({"pairs": same, "marks": marks}), source="source_segment", target="target_segment")
    return out.select("text_id", "ref", F.inline("marks")).select("text_id", "ref", F.col("at").alias("mark"), "place")
