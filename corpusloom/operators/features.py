"""Feature structures as maps from a feature's name to the set of its possible symbols, a bit each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unifiable(a: Column, b: Column) -> Column:
    """Whether all features that both have share a symbol; a feature that one lacks is open."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull() | y.isNull(), True).otherwise(x.bitwiseAND(y) != 0))
    return F.forall(F.map_values(both), lambda ok: ok)


def unify(a: Column, b: Column) -> Column:
    """Both structures' demands together; null if they contradict each other."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.bitwiseAND(y), x, y))
    return F.when(unifiable(a, b), both)


def subsumes(a: Column, b: Column) -> Column:
    """Whether b has each feature of a, with no symbol that a doesn't allow."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), True).when(y.isNull(), False).otherwise(x.bitwiseAND(y) == y))
    return F.forall(F.map_values(both), lambda ok: ok)


def priority_union(a: Column, b: Column) -> Column:
    """a with b's features, which go before a's."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))



def union(a: Column, b: Column) -> Column:
    """What either structure allows: features that both have, with all their symbols."""
    both = F.map_zip_with(a, b, lambda k, x, y: x.bitwiseOR(y))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def add(a: Column, b: Column) -> Column:
    """a with b's features, symbols of features that both have put together."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.bitwiseOR(y), x, y))


def subtract(a: Column, b: Column) -> Column:
    """a without b's symbols; a feature without any left goes."""
    left = F.map_zip_with(a, b, lambda k, x, y: F.when(y.isNull(), x).otherwise(x.bitwiseAND(F.bitwise_not(y))))
    return F.map_filter(left, lambda k, v: v.isNotNull() & (v != 0))
