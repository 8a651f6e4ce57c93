"""Quotation conventions: which standard ones fit the marks that a text uses, and how well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard conventions: the opening and closing mark of each level, from the outermost. Fixed values.
STANDARD = {
    "standard_english": "“” ‘’ “” ‘’",
    "typewriter_english": "\"\" '' \"\" ''",
    "british_english": "‘’ “” ‘’ “”",
    "british_typewriter_english": "'' \"\" '' \"\"",
    "hybrid_typewriter_english": "“” '' \"\"",
    "standard_french": "«» ‹› «» ‹›",
    "typewriter_french": "<<>> <> <<>> <>",
    "french_variant": "«» ‹› “” ‘’",
    "western_european": "«» “” ‘’",
    "british_inspired_western_european": "«» ‘’ “”",
    "typewriter_western_european": "<<>> \"\" ''",
    "typewriter_western_european_variant": "\"\" <> ''",
    "hybrid_typewriter_western_european": "«» \"\" ''",
    "hybrid_british_typewriter_western_european": "«» '' \"\"",
    "central_european": "„“ ‚‘ „“ ‚‘",
    "central_european_guillemets": "»« ›‹ »« ›‹",
    "standard_swedish": "”” ’’ ”” ’’",
    "standard_finnish": "»» ’’",
    "eastern_european": "„” ‚’ „” ‚’",
    "standard_russian": "«» „“ ‚‘",
    "standard_arabic": "”“ ’‘ ”“ ’‘",
    "non-standard_arabic": "«» ’‘",
    "arabic_inspired_western_european": "«» ”“ ’‘",
}


def conventions(spark: SparkSession) -> DataFrame:
    """(name, level, opening, closing), a row for each level of each standard convention."""
    rows = [(n, i + 1, pair[: len(pair) // 2], pair[len(pair) // 2 :]) for n, levels in STANDARD.items() for i, pair in enumerate(levels.split())]
    return spark.createDataFrame(rows, "name string, level int, opening string, closing string")


def _literal() -> Column:
    """All conventions as one array: a join with so few rows needs no join."""
    made = []
    for name, levels in STANDARD.items():
        pairs = [(p[: len(p) // 2], p[len(p) // 2 :]) for p in levels.split()]
        made.append(F.struct(F.lit(name).alias("name"), F.array(*[F.lit(a) for a, _ in pairs]).alias("opening"), F.array(*[F.lit(b) for _, b in pairs]).alias("closing")))
    return F.array(*made)


def compatible(observed: DataFrame, *key: str) -> DataFrame:
    """(key, name) of the conventions that have all marks observed, of rows (key, opening, closing: arrays).

    The marks of the first level must be among those observed.
    """

    def fits(c: Column) -> Column:
        has = lambda seen, own: (F.size(F.array_except(seen, own)) == 0) & F.array_contains(seen, own[0])
        return has(F.col("opening"), c["opening"]) & has(F.col("closing"), c["closing"])

    return observed.select(*key, F.explode(F.transform(F.filter(_literal(), fits), lambda c: c["name"])).alias("name"))


def tabulate(marks: DataFrame, *key: str) -> DataFrame:
    """(key, depth, direction, mark, n) of single marks; direction is opening or closing."""
    return marks.groupBy(*key, "depth", "direction", "mark").agg(F.count("*").alias("n"))


def similarity(counts: DataFrame, *key: str) -> DataFrame:
    """(key, name, score) of tabulated marks with each standard convention, score from 0 to 1.

    The share of a depth's marks that are as expected counts in full only as far as the depth above it
    has its marks as expected.
    """
    rows = counts.select("*", F.explode(_literal()).alias("c"))
    own = F.when(F.col("direction") == "opening", F.col("c.opening")).otherwise(F.col("c.closing"))
    expected = F.get(own, F.col("depth") - 1)
    rows = rows.groupBy(*key, F.col("c.name").alias("name"), "depth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mark") == expected, F.col("n")).otherwise(0)).alias("same"))
    depths = F.array_sort(F.collect_list(F.struct("depth", "n", "same")))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("last"), F.lit(1.0).alias("rate"))

    def step(s: Column, d: Column) -> Column:
        above = F.when(d["depth"] == s["last"] + 1, s["rate"]).otherwise(1.0)
        return F.struct((s["total"] + above * d["same"]).alias("total"), d["depth"].alias("last"), (above * d["same"] / d["n"]).alias("rate"))

    return rows.withColumn("depth", F.col("depth").cast("int")).groupBy(*key, "name").agg((F.aggregate(depths, start, step)["total"] / F.sum("n")).alias("score"))


def marks_in_context(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, at, mark, before, after: quotation marks with their places from 0 and their neighbours ('' at the ends).

    Double angle brackets are one mark. direction is opening, closing or unclear by white space or the
    text's ends around a mark, apostrophe if letters are on both sides of a single one.
    """
    pieces, found = F.split(F.col(text), MARK, -1), F.regexp_extract_all(F.col(text), F.lit(f"({MARK})"), F.lit(1))
    rows = texts.select(*key, pieces.alias("p"), F.posexplode(found).alias("k", "mark"), found.alias("all"))
    # What is before a mark: the pieces and marks up to it.
    end = lambda s: F.right(s, F.lit(1))
    before = F.when(F.expr("p[k]") != "", end(F.expr("p[k]"))).when(F.col("k") > 0, end(F.expr("all[k - 1]"))).otherwise("")
    after = F.when(F.expr("p[k + 1]") != "", F.left(F.expr("p[k + 1]"), F.lit(1))).otherwise(F.coalesce(F.left(F.expr("get(all, k + 1)"), F.lit(1)), F.lit("")))
    rows = rows.select(*key, "k", "mark", before.alias("before"), after.alias("after"))
    gap = lambda c: F.col(c).rlike(r"^\s?$")
    letter = lambda c: F.col(c).rlike(r"^\p{L}$")
    direction = F.when(letter("before") & letter("after") & F.col("mark").isin("'", "’"), "apostrophe").when(gap("before") & ~gap("after"), "opening").when(~gap("before") & gap("after"), "closing").otherwise("unclear")
    return rows.withColumn("direction", direction)


#: Quotation marks, and pairs of angle brackets that stand for them. Fixed values.
MARK = "<<|>>|[\"“”„‟'‘’‚‛«»‹›]"
