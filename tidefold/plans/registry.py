"""All queries of the library by name."""

from tidefold.plans import app_queries, state_queries, vector_queries

QUERIES = state_queries.QUERIES | vector_queries.QUERIES | app_queries.QUERIES
SQL = state_queries.SQL | vector_queries.SQL | app_queries.SQL
