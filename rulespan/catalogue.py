"""All queries and their SQL, by name."""

from rulespan import queries, source_queries

QUERIES, SQL = queries.QUERIES, queries.SQL

__all__ = ["QUERIES", "SQL", "queries", "source_queries"]
