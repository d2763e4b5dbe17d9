"""Registered queries; importing the package registers all of them."""

from lorebase.plans import queries  # noqa: I001  the others add to its tables
from lorebase.plans import checked_queries, hybrid_queries, loop_queries, search_queries, text_queries

QUERIES, SQL = queries.QUERIES, queries.SQL
__all__ = ["QUERIES", "SQL", "checked_queries", "hybrid_queries", "loop_queries", "queries", "search_queries", "text_queries"]
