"""All queries of the library proper, with the DuckDB SQL that gives the same rows."""

from corpusloom.plans import corpus, joins, markup, measures, models, scripture, segments  # noqa: F401  they register their queries
from corpusloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
