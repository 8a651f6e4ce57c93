"""Queries of statistics, n-gram models, evaluation, word alignment, vectors and words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, hmm, joins, lattices, morphology, neighbourhoods, statistics, trees, word_alignment
from ..storage import stash
from .corpus import TOKENS_SQL, tokens
from .joins import sides
from .registry import query, table

WORDS_SQL = f"w AS (SELECT lang, lower(unnest({TOKENS_SQL})) AS word FROM documents)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.explode(tokens()).alias("word")).withColumn("word", F.lower("word"))


@query("word_frequency", f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM w GROUP BY word")
def word_frequency(spark, sf_dir):
    return statistics.frequency(words(spark, sf_dir), "word")


@query("cond_freq_by_lang", f"WITH {WORDS_SQL} SELECT lang, word[1:2] AS start, count(*) AS cnt FROM w GROUP BY ALL")
def cond_freq_by_lang(spark, sf_dir):
    return statistics.frequency(words(spark, sf_dir).withColumn("start", F.substring("word", 1, 2)), "lang", "start")


STARTS_SQL = f"WITH {WORDS_SQL}, c AS (SELECT lang, word[1:2] AS start, count(*) AS cnt FROM w GROUP BY ALL), t AS (SELECT lang, sum(cnt) AS n, count(*) AS t FROM c GROUP BY lang)"


@query("lidstone_prob", f"{STARTS_SQL} SELECT lang, start, cnt, round((cnt + 0.5) / (n + (t + 1) * 0.5), 9) AS prob, round(0.5 / (n + (t + 1) * 0.5), 9) AS unseen FROM c JOIN t USING (lang)")
def lidstone_prob(spark, sf_dir):
    out = statistics.lidstone(cond_freq_by_lang(spark, sf_dir), "lang")
    return out.select("lang", "start", "cnt", F.round("prob", 9).alias("prob"), F.round("unseen", 9).alias("unseen"))


@query("witten_bell_prob", f"{STARTS_SQL} SELECT lang, start, cnt, round(cnt / (n + t), 9) AS prob, round(t / (n + t), 9) AS unseen FROM c JOIN t USING (lang)")
def witten_bell_prob(spark, sf_dir):
    out = statistics.witten_bell(cond_freq_by_lang(spark, sf_dir), "lang")
    return out.select("lang", "start", "cnt", F.round("prob", 9).alias("prob"), F.round("unseen", 9).alias("unseen"))


@query(
    "sgt_prob",
    f"""WITH {WORDS_SQL}, c AS (SELECT word, count(*) AS cnt FROM w GROUP BY word), nr AS (SELECT cnt AS r, count(*)::DOUBLE AS nr FROM c GROUP BY cnt),
    g AS (SELECT r, nr, coalesce(lag(r) OVER o, 0) AS q, lead(r) OVER o AS s, lead(nr) OVER o AS nx FROM nr WINDOW o AS (ORDER BY r)),
    z AS (SELECT *, ln(r) AS x, ln(CASE WHEN s IS NULL THEN nr / (r - q) ELSE 2 * nr / (s - q) END) AS y FROM g),
    l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM z),
    e AS (SELECT r, nr, s, nx, (r + 1) * exp(a + b * ln(r + 1)) / exp(a + b * ln(r)) AS li, (r + 1) * nx / nr AS di, sqrt((r + 1) * (r + 1) * nx / (nr * nr) * (1 + nx / nr)) AS sd FROM z, l),
    u AS (SELECT *, max(CASE WHEN s IS NULL OR s <> r + 1 OR abs(di - li) <= 1.96 * sd THEN 1 ELSE 0 END) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS sw FROM e)
    SELECT r AS cnt, round(CASE WHEN sw = 1 THEN li ELSE di END, 6) AS smoothed, sw = 1 AS switched FROM u""",
)
def sgt_prob(spark, sf_dir):
    return statistics.good_turing(word_frequency(spark, sf_dir)).select("cnt", F.round("smoothed", 6).alias("smoothed"), "switched")


def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.transform(tokens(), F.lower).alias("tokens"))


BIGRAM_SQL = f"""WITH b AS (SELECT list_transform({TOKENS_SQL}, lambda x: lower(x)) AS t FROM documents),
u AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(t) AS word FROM b) GROUP BY word),
g AS (SELECT t[i] AS context, t[i + 1] AS word, count(*) AS cnt FROM (SELECT t, unnest(range(1, len(t))) AS i FROM b) GROUP BY ALL),
c AS (SELECT context, sum(cnt) AS n, count(*) AS k, count(*) FILTER (cnt = 1) AS n1, count(*) FILTER (cnt = 2) AS n2, count(*) FILTER (cnt > 2) AS n3 FROM g GROUP BY context),
p AS (SELECT word, cnt / sum(cnt) OVER () AS prob FROM u)"""


@query("ngram_counts", f"{BIGRAM_SQL} SELECT context, word, cnt FROM g")
def ngram_counts(spark, sf_dir):
    return statistics.ngram_counts(text_tokens(spark, sf_dir), 2).select(F.col("context")[0].alias("context"), "word", "cnt")


@query("bigram_mle", f"{BIGRAM_SQL} SELECT context, word, round(cnt / n, 9) AS prob FROM g JOIN c USING (context)")
def bigram_mle(spark, sf_dir):
    return statistics.ngram_max_likelihood(text_tokens(spark, sf_dir), 2).select(F.col("context")[0].alias("context"), "word", F.round("prob", 9).alias("prob"))


@query("bigram_witten_bell", f"{BIGRAM_SQL} SELECT context, g.word, round((g.cnt + k * p.prob) / (n + k), 9) AS prob FROM g JOIN c USING (context) JOIN p ON g.word = p.word")
def bigram_witten_bell(spark, sf_dir):
    return statistics.ngram_witten_bell(text_tokens(spark, sf_dir), 2).select(F.col("context")[0].alias("context"), "word", F.round("prob", 9).alias("prob"))


@query(
    "bigram_kneser_ney",
    f"""{BIGRAM_SQL}, k AS (SELECT count(*) FILTER (cnt = 1)::DOUBLE AS c1, count(*) FILTER (cnt = 2)::DOUBLE AS c2, count(*) FILTER (cnt = 3)::DOUBLE AS c3, count(*) FILTER (cnt = 4)::DOUBLE AS c4 FROM g),
    d AS (SELECT CASE WHEN c1 > 0 THEN 1 - 2 * (c1 / (c1 + 2 * c2)) * c2 / c1 ELSE 0 END AS d1, CASE WHEN c2 > 0 THEN 2 - 3 * (c1 / (c1 + 2 * c2)) * c3 / c2 ELSE 0 END AS d2, CASE WHEN c3 > 0 THEN 3 - 4 * (c1 / (c1 + 2 * c2)) * c4 / c3 ELSE 0 END AS d3 FROM k)
    SELECT context, g.word, round((cnt - CASE cnt WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / n + (d1 * n1 + d2 * n2 + d3 * n3) / n * p.prob, 9) AS prob FROM g JOIN c USING (context) JOIN p ON g.word = p.word, d""",
)
def bigram_kneser_ney(spark, sf_dir):
    return statistics.ngram_kneser_ney(text_tokens(spark, sf_dir), 2).select(F.col("context")[0].alias("context"), "word", F.round("prob", 9).alias("prob"))


@query(
    "bleu_corpus",
    f"""WITH r AS (SELECT row_number() OVER () AS id, {TOKENS_SQL} AS h FROM conversations), p AS (SELECT id, h, list_transform(h, lambda x: lower(x)) AS f FROM r),
    k AS (SELECT unnest([1, 2, 3, 4]) AS n),
    gh AS (SELECT id, n, h[i:i + n - 1] AS g, count(*) AS c FROM (SELECT id, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM p, k) GROUP BY ALL),
    gf AS (SELECT id, n, f[i:i + n - 1] AS g, count(*) AS c FROM (SELECT id, f, n, unnest(range(1, len(f) - n + 2)) AS i FROM p, k) GROUP BY ALL),
    m AS (SELECT gh.n AS n, sum(gh.c) AS total, sum(least(gh.c, coalesce(gf.c, 0))) AS same FROM gh LEFT JOIN gf ON gh.id = gf.id AND gh.n = gf.n AND gh.g = gf.g GROUP BY gh.n)
    SELECT round(exp(sum(ln(same / total)) / 4), 6) AS bleu FROM m""",
)
def bleu_corpus(spark, sf_dir):
    """How well turns match their lower-case selves: whole tokens, up to four in a row."""
    turns = table(spark, sf_dir, "conversations").select(tokens().alias("h"))
    return evaluation.bleu(turns.withColumn("f", F.transform("h", F.lower)), "h", "f").select(F.round("bleu", 6).alias("bleu"))


@query(
    "alignment_aer_f",
    """WITH a AS (SELECT DISTINCT l_orderkey AS seg, l_linenumber AS i, l_linenumber % 4 AS j FROM lineitem WHERE l_quantity > 10),
    g AS (SELECT l_orderkey AS seg, l_linenumber AS i, l_linenumber % 4 AS j, bool_or(l_discount > 0.04) AS sure FROM lineitem WHERE l_quantity < 40 GROUP BY ALL),
    n AS (SELECT count(*) FILTER (a.seg IS NOT NULL) AS a, count(*) FILTER (g.sure) AS s, count(*) FILTER (a.seg IS NOT NULL AND g.seg IS NOT NULL) AS ap, count(*) FILTER (a.seg IS NOT NULL AND g.sure) AS sa FROM a FULL JOIN g ON a.seg = g.seg AND a.i = g.i AND a.j = g.j)
    SELECT round(1 - (ap + sa) / (s + a), 9) AS aer, round(ap / a, 9) AS precision, round(sa / s, 9) AS recall, round(1 / (0.5 / (ap / a) + 0.5 / (sa / s)), 9) AS f_score FROM n""",
)
def alignment_aer_f(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") % 4).alias("j"), "l_quantity", (F.col("l_discount") > 0.04).alias("sure"))
    out = evaluation.alignment_scores(lines.where("l_quantity > 10"), lines.where("l_quantity < 40").drop("l_quantity"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


CHRF_SQL = """WITH e AS (SELECT event_type, user_id, (abs(value) / (1 + abs(value))) AS confidence FROM events WHERE value IS NOT NULL),
u AS (SELECT *, 109.6145 * confidence - 14.0633 AS chrf3 FROM e),
p AS (SELECT *, 263 * exp(-((chrf3 - 51.4) ** 2) / (2 * 95.19)) AS good, 97 * exp(-((chrf3 - 45.85) ** 2) / (2 * 99.91)) AS bad FROM u)"""


def confidences(spark, sf_dir):
    v = F.abs("value")
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", "event_type", (v / (1 + v)).alias("confidence"))


@query(
    "chrf3_texts",
    f"{CHRF_SQL} SELECT event_type, round(CASE WHEN min(confidence) > 0 THEN exp(avg(ln(confidence))) ELSE 0 END, 6) AS confidence, round(109.6145 * CASE WHEN min(confidence) > 0 THEN exp(avg(ln(confidence))) ELSE 0 END - 14.0633, 4) AS chrf3, round(avg(good / (good + bad)), 6) AS usability, CASE WHEN avg(good / (good + bad)) >= 0.776 THEN 'Green' WHEN avg(good / (good + bad)) >= 0.681 THEN 'Yellow' ELSE 'Red' END AS label FROM p GROUP BY event_type".replace("ln(confidence)", "ln(CASE WHEN confidence > 0 THEN confidence END)"),
)
def chrf3_texts(spark, sf_dir):
    out = evaluation.chrf3_estimates(confidences(spark, sf_dir), 109.6145, -14.0633, "event_type")
    return out.select("event_type", F.round("confidence", 6).alias("confidence"), F.round("chrf3", 4).alias("chrf3"), F.round("usability", 6).alias("usability"), "label")


@query("chrf3_segments", CHRF_SQL.replace("event_type, user_id", "event_id, event_type") + " SELECT event_id, round(chrf3, 4) AS chrf3, round(good / (good + bad), 6) AS usability FROM p")
def chrf3_segments(spark, sf_dir):
    rows = confidences(spark, sf_dir).withColumn("x", 109.6145 * F.col("confidence") - 14.0633)
    return rows.select("event_id", F.round("x", 4).alias("chrf3"), F.round(evaluation.usability(F.col("x")), 6).alias("usability"))


@query("geometric_mean", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def geometric_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.geometric_mean(F.col("l_quantity")), 6).alias("mean"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("u")), "id")


PAIR_SQL = "FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS u FROM embeddings) b USING (vec_id)"


@query("cosine_pairs", f"SELECT vec_id AS id, round(list_cosine_similarity(v, u), 6) AS cosine {PAIR_SQL}")
def cosine_pairs(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(statistics.cosine(F.col("v"), F.col("u")), 6).alias("cosine"))


@query("euclid_pairs", f"SELECT vec_id AS id, round(list_distance(v, u), 6) AS distance {PAIR_SQL}")
def euclid_pairs(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(statistics.euclidean(F.col("v"), F.col("u")), 6).alias("distance"))


@query(
    "js_divergence",
    f"""WITH {WORDS_SQL}, c AS (SELECT lang, word[1:1] AS x, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT lang, x, n / sum(n) OVER (PARTITION BY lang) AS p FROM c),
    l AS (SELECT DISTINCT lang FROM p), k AS (SELECT DISTINCT x FROM p),
    f AS (SELECT l.lang AS lang, k.x AS x, coalesce(p.p, 0) AS p FROM l CROSS JOIN k LEFT JOIN p ON p.lang = l.lang AND p.x = k.x)
    SELECT a.lang AS one, b.lang AS two, round(sum(CASE WHEN a.p > 0 THEN a.p * log2(a.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN b.p > 0 THEN b.p * log2(b.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2, 6) AS js
    FROM f a JOIN f b ON a.x = b.x AND a.lang < b.lang GROUP BY ALL""",
)
def js_divergence(spark, sf_dir):
    counts = statistics.frequency(words(spark, sf_dir).withColumn("x", F.substring("word", 1, 1)), "lang", "x")
    return statistics.divergences(statistics.max_likelihood(counts, "lang"), "lang", "x").select("one", "two", F.round("js", 6).alias("js"))


@query("affix_counts", f"WITH {WORDS_SQL}, d AS (SELECT DISTINCT word FROM w), s AS (SELECT word, unnest(range(1, least(4, length(word) - 1) + 1)) AS n FROM d WHERE length(word) > 1) SELECT right(word, n) AS affix, count(*) AS n_words FROM s GROUP BY ALL")
def affix_counts(spark, sf_dir):
    return morphology.affix_counts(words(spark, sf_dir), 4)


@query("affix_scores")
def affix_scores(spark, sf_dir):
    return morphology.affix_scores(words(spark, sf_dir))


@query("levenshtein_pairs", "SELECT a.p_partkey AS p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def levenshtein_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("bigint").alias("distance"))


@query("truecase_model")
def truecase_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}]+|[^\s\p{L}]"), F.lit(0)).alias("tokens"), F.lit(True).alias("sentence_start"))
    return morphology.truecaser(docs, ["doc_id"])


def _parallel(spark, sf_dir):
    rows = joins.align_rows(*sides(spark, sf_dir))
    lower = lambda c: F.transform(c, F.lower).alias(c)
    return rows.select(F.xxhash64("text_id", "ref").alias("seg"), lower("source_segment"), lower("target_segment")).where("size(source_segment) > 0 and size(target_segment) > 0")


@query("ibm1_ttable")
def ibm1_ttable(spark, sf_dir):
    return word_alignment.ibm1(_parallel(spark, sf_dir)).table()


@query("lexicon_beam")
def lexicon_beam(spark, sf_dir):
    return word_alignment.lexicon(word_alignment.ibm1(_parallel(spark, sf_dir)).table(), 0.01)


@query("symmetrize_gdfa")
def symmetrize_gdfa(spark, sf_dir):
    rows = _parallel(spark, sf_dir)
    back = rows.select("seg", F.col("target_segment").alias("source_segment"), F.col("source_segment").alias("target_segment"))
    pairs = lambda best: best.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pairs"))
    direct = pairs(word_alignment.ibm1(rows).best()).withColumnRenamed("pairs", "direct")
    other = word_alignment.ibm1(back).best().select("seg", F.col("j").alias("i"), F.col("i").alias("j"))
    inverse = pairs(other).withColumnRenamed("pairs", "inverse")
    none = F.array().cast("array<struct<i:int,j:int>>")  # all words of a segment may go to the null word
    whole = rows.select("seg").distinct().join(direct, "seg", "left").join(inverse, "seg", "left")
    both = word_alignment.symmetrize_rows(whole.select("seg", F.coalesce("direct", none).alias("direct"), F.coalesce("inverse", none).alias("inverse")))
    return both.select("seg", word_alignment.to_pharaoh(F.col("pairs")).alias("pairs"))


@query("diagonal_ttable")
def diagonal_ttable(spark, sf_dir):
    return word_alignment.diagonal(_parallel(spark, sf_dir)).table()


@query("hmm_pairs")
def hmm_pairs(spark, sf_dir):
    rows = _parallel(spark, sf_dir)
    return hmm.align_hmm(rows, *hmm.train_hmm(rows)).select("seg", word_alignment.to_pharaoh(F.col("pairs")).alias("pairs"))


@query("translation_scores")
def translation_scores(spark, sf_dir):
    rows = _parallel(spark, sf_dir)
    return word_alignment.ibm1(rows).scores()


@query("truecase_rows")
def truecase_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}]+|[^\s\p{L}]"), F.lit(0)).alias("tokens"), F.lit(True).alias("sentence_start"))
    return morphology.truecase(docs, truecase_model(spark, sf_dir), ["doc_id"])


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query("dbscan_embeddings")
def dbscan_embeddings(spark, sf_dir):
    return neighbourhoods.dbscan(vectors(spark, sf_dir), 0.5, 4)


@query(
    "near_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS dist FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_distance(a.e, b.e) <= 1.1""",
)
def near_vectors(spark, sf_dir):
    """Pairs of different embeddings within a distance."""
    near = neighbourhoods.within(neighbourhoods.distinct_points(vectors(spark, sf_dir)), 1.1)
    return near.select("a", "b", F.round("dist", 6).alias("dist"))


@query("density_clusters")
def density_clusters(spark, sf_dir):
    """Clusters at two heights of one mutual reachability tree."""
    points = vectors(spark, sf_dir)
    near = stash(neighbourhoods.within(neighbourhoods.distinct_points(points), 1.2), "near")
    cores, tree = neighbourhoods.reachability(points, 1.2, 4, near)
    at = lambda height: neighbourhoods.clusters_at(points, cores, tree, height, 1.2, near).withColumn("height", F.lit(height))
    return at(1.1).unionByName(at(1.2))


def label_distances(spark, sf_dir):
    """Labels of embeddings and the distances of their mean vectors."""
    rows = vectors(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    each = rows.select(F.col("label").cast("bigint").alias("id"), F.posexplode("vector").alias("place", "x")).groupBy("id", "place").agg(F.avg("x").alias("x"))
    means = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"))
    other = means.select(F.col("id").alias("b"), F.col("mean").alias("other"))
    return means.select("id"), means.join(other, F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", statistics.euclidean(F.col("mean"), F.col("other")).alias("dist"))


@query("label_tree")
def label_tree(spark, sf_dir):
    return trees.average_linkage(*label_distances(spark, sf_dir))


@query("label_joining")
def label_joining(spark, sf_dir):
    return trees.neighbour_joining(*label_distances(spark, sf_dir))


def order_graphs(spark, sf_dir):
    """A graph for each order: its line items lead from their number to the next; of several with one number each is a way."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("prev"), F.log("l_quantity").alias("score"), F.array("l_returnflag").alias("words"))
    return lines.withColumn("next", F.col("prev") + 1)


@query(
    "word_confidences",
    """WITH e AS (SELECT l_orderkey AS graph, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, l_returnflag AS word, l_quantity AS w FROM lineitem),
    p AS (SELECT graph, place, word, sum(w) AS w FROM e GROUP BY ALL), t AS (SELECT graph, place, sum(w) AS total FROM e GROUP BY ALL)
    SELECT graph, word, floor(max(w / total) * 1e6 + 0.3)::BIGINT AS millionths FROM p JOIN t USING (graph, place) GROUP BY ALL""",
)
def word_confidences(spark, sf_dir):
    """Confidences in millionths, rounded where no share of whole numbers this small lies half-way."""
    found = lattices.word_confidences(order_graphs(spark, sf_dir))
    return found.select("graph", "word", F.floor(F.col("confidence") * 1e6 + 0.3).cast("bigint").alias("millionths"))


@query(
    "best_paths",
    """WITH e AS (SELECT l_orderkey AS graph, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, max(l_quantity) AS w FROM (SELECT *, l_linenumber FROM lineitem) GROUP BY l_orderkey, l_linenumber)
    SELECT graph, count(*) AS n_words, round(sum(ln(w)), 6) AS score FROM e GROUP BY graph""",
)
def best_paths(spark, sf_dir):
    return lattices.best_paths(order_graphs(spark, sf_dir)).select("graph", F.size("words").cast("bigint").alias("n_words"), F.round("score", 6).alias("score"))
