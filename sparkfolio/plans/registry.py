"""Queries by name, and for each the SQL that gives the same rows."""

from . import app_queries, exchange_queries, layout_queries, record_queries, solve_queries, store_queries, text_queries

MODULES = (text_queries, layout_queries, record_queries, solve_queries, app_queries, exchange_queries, store_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
