"""Registered queries over the test tables, with their SQL twins."""

from . import document_queries, matching_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
