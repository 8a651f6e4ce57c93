"""Trees of objects by their distances: average linkage and neighbour joining, in rounds over a table of distances.

Distances are rows (a, b, dist), a < b. Each round of average linkage joins all pairs of clusters that are each other's
nearest, for such a pair is joined sooner or later whatever else is joined before it; the rows of the two are then put together
by sizes. Half the clusters or so are gone after each round, and a round is a few aggregations and joins, so a tree of n objects takes
about log n rounds over at most n (n - 1) / 2 rows. Neighbour joining must take its pairs one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stash


def _both(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in rows.columns if c not in ("a", "b")]))


def _nearest(both: DataFrame) -> DataFrame:
    """Each cluster's nearest; of equals the pair with the lesser numbers, so that there always is a mutual pair."""
    return both.groupBy("a").agg(F.min(F.struct("dist", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("x")).select("a", "x.b", "x.dist")


def average_linkage(objects: DataFrame, distances: DataFrame) -> DataFrame:
    """(node, left, right, height, size) of the joins of objects (id, a number) by the mean distance of their members (UPGMA).

    distances has a row (a, b, dist) for each pair of objects. A join's node is the lesser of its two nodes, left; height is half the
    distance of what it joins. Objects that no row names stay apart, as do those without rows between them.
    """
    sizes = stash(objects.select(F.col("id").alias("a"), F.lit(1).cast("bigint").alias("size")), "sizes")
    rows = stash(distances.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("dist").cast("double").alias("dist")), "distances")
    joins = []
    while not rows.isEmpty():
        near = stash(_nearest(_both(rows)), "nearest")
        mutual = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
        size = lambda c: sizes.select(F.col("a").alias(c), F.col("size").alias(f"size_{c}"))
        joined = stash(mutual.join(size("a"), "a").join(size("b"), "b"), "joined")
        joins.append(stash(joined.select(F.col("a").alias("node"), F.col("a").alias("left"), F.col("b").alias("right"), (F.col("dist") / 2).alias("height"), (F.col("size_a") + F.col("size_b")).alias("size")), "joins"))
        # Where each cluster goes, and its weight in the new one's distances.
        share = lambda c: (F.col(f"size_{c}") / (F.col("size_a") + F.col("size_b")))
        to = joined.select(F.col("a").alias("old"), F.col("a").alias("new"), share("a").alias("w")).unionByName(joined.select(F.col("b").alias("old"), F.col("a").alias("new"), share("b").alias("w")))
        moved = lambda df, c: df.join(to.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("w").alias(f"w_{c}")), c, "left")
        both = moved(moved(rows, "a"), "b").select(F.coalesce("new_a", "a").alias("p"), F.coalesce("new_b", "b").alias("q"), (F.col("dist") * F.coalesce("w_a", F.lit(1.0)) * F.coalesce("w_b", F.lit(1.0))).alias("part")).where("p <> q")
        rows = stash(both.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("part").alias("dist")), "distances")
        grown = joined.select(F.col("a"), (F.col("size_a") + F.col("size_b")).alias("more"))
        gone = joined.select(F.col("b").alias("a"))
        sizes = stash(sizes.join(gone, "a", "left_anti").join(grown, "a", "left").select("a", F.coalesce("more", "size").alias("size")), "sizes")
    kind = objects.schema["id"].dataType.simpleString()
    out = objects.sparkSession.createDataFrame([], f"node {kind}, left {kind}, right {kind}, height double, size bigint")
    for j in joins:
        out = out.unionByName(j)
    return out


def flat_clusters(objects: DataFrame, tree: DataFrame, height: float) -> DataFrame:
    """(id, cluster) of an average_linkage tree cut at a height: what is joined up to it is one cluster, named by its least object."""
    from .graph import components

    roots = components(tree.where(F.col("height") <= height).select(F.col("left").alias("u"), F.col("right").alias("v")))
    return objects.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def neighbour_joining(objects: DataFrame, distances: DataFrame) -> DataFrame:
    """(node, parent, length): the edges of the unrooted tree of objects (id, a number of 0 or more) by neighbour joining.

    Inner nodes have negative numbers, in the order of their making; the last two nodes are joined by one edge. A pair is
    chosen by the least of (n - 2) d(a, b) - r(a) - r(b), r being sums of distances; of equals by the lesser numbers. Each join is a round: the sums
    by an aggregation, the pair by a least value, the new rows by a join, so a round's work is that of its rows, and there are as many rounds as
    objects. Distances need a row for each pair.
    """
    kind = objects.schema["id"].dataType.simpleString()
    rows = stash(distances.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("dist").cast("double").alias("dist")), "distances")
    left, made, edges = objects.count(), 0, []
    while left > 2:
        both = _both(rows)
        sums = stash(both.groupBy("a").agg(F.sum("dist").alias("r")), "sums")
        q = rows.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("r").alias("s")), "b").withColumn("q", F.round((left - 2) * F.col("dist") - F.col("r") - F.col("s"), 9))
        best = q.agg(F.min(F.struct("q", "a", "b", "dist", "r", "s")).alias("x")).first()["x"]
        made -= 1
        a, b, d = best["a"], best["b"], best["dist"]
        to_a = d / 2 + (best["r"] - best["s"]) / (2 * (left - 2))
        edges += [(a, made, to_a), (b, made, d - to_a)]
        of = both.where(F.col("a").isin(a, b) & ~F.col("b").isin(a, b)).groupBy("b").agg(((F.sum("dist") - d) / 2).alias("dist"))
        fresh = of.select(F.least(F.lit(made).cast(kind), "b").alias("a"), F.greatest(F.lit(made).cast(kind), "b").alias("b"), "dist")
        rows = stash(rows.where(~F.col("a").isin(a, b) & ~F.col("b").isin(a, b)).unionByName(fresh), "distances")
        left -= 1
    edges += [(r["a"], r["b"], r["dist"]) for r in rows.collect()]  # one row, or none
    return objects.sparkSession.createDataFrame(edges, f"node {kind}, parent {kind}, length double") if edges else rows.selectExpr("a AS node", "b AS parent", "dist AS length")
