"""All queries of the library and their SQL."""

from .plans import sequence_queries, source_queries  # noqa: F401  register their queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
