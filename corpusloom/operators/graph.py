"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash


def _pair(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups > 0 AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v); root is the least node of its component.

    Each round takes partial minima by node and joins them back, so no node's edges are gathered. The
    table is written to the shared folder after each round, until it is stars around the roots. A round
    reads it four times and no more, as the driver holds the plans. No edges: no rows.
    """
    edges = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:
        both = edges.select(F.inline(F.array(_pair("u", "v"), _pair("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(_pair("v", "m"), _pair("u", "m"))))
        edges = stash(small.where("u <> v").distinct(), "edges")
        if _are_stars(edges):
            break
    return edges.select(F.inline(F.array(_pair("u", "v"), _pair("v", "v")))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
