"""A total order of documents over partitions, without sampling the rows twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundaries(df: DataFrame, n: int, key: str = "doc_id") -> list[int]:
    """At most n - 1 increasing keys that cut df into parts of about equal rows."""
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("x")).first()["x"]
    return sorted(set(cuts or []))


def part_of(key: str, cuts: list[int]) -> Column:
    """The number of cuts below a key (null: 0), found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])
    fine = F.array(*[F.lit(c) for c in cuts])
    blocks = F.size(F.filter(coarse, lambda c: c < F.col(key)))
    rest = F.slice(fine, blocks * step + 1, step)
    return F.coalesce(blocks * step + F.size(F.filter(rest, lambda c: c < F.col(key))), F.lit(0)).cast("int")


def parts(df: DataFrame) -> int:
    """Partitions for an ordered table: as many as shuffles have."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
