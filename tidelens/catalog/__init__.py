"""Registry of named queries over the given tables, each with equivalent SQL where SQL can say it."""

from tidelens.catalog.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
