"""Joins that hold at any size: broadcasts below a counted number of bytes, and hot keys apart from all others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a helper table is broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 24 << 20
#: A key with more than this share of a table's rows is joined by broadcast; there are at most as many such keys.
HOT_SHARE = 1 / 1024


def n_bytes(df: DataFrame) -> int:
    """About the bytes of a table's rows, counted: 16 a row, 16 a column, and what strings, binaries and arrays hold."""
    held = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind.startswith("array"):
            held = held + 16 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return df.agg(F.sum(held.cast("bigint") + 16 + 16 * len(df.columns))).first()[0] or 0


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a table at rest, with a broadcast hint if its counted bytes stay below the limit, else as it is."""
    return F.broadcast(df) if n_bytes(df) <= limit else df


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", small: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with a table at rest of one row for each of their keys, n saying how many rows have it.

    A small table is broadcast by its counted bytes. Of a large one, only the hot keys are, of which there are at
    most 1 / HOT_SHARE by their definition; the rows of all others are shuffled, and no task gets a hot key. Null keys are
    equal to each other.
    """
    groups = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    gone = [f"__{k}" for k in keys]
    if n_bytes(groups) <= small:
        return rows.join(F.broadcast(groups), same).drop(*gone)
    most = groups.agg(F.sum(n)).first()[0] * HOT_SHARE
    hot = F.broadcast(groups.where(F.col(n) > most))
    of_hot = rows.join(hot, same).drop(*gone)
    others = rows.join(hot.select(*gone), same, "left_anti").join(groups.where(F.col(n) <= most), same).drop(*gone)
    return of_hot.unionByName(others)
