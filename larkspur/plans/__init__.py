"""Importing the package registers every query."""

from . import deal_queries, event_queries, page_queries, path_queries, queries, record_queries, rule_queries, sheet_queries, store_queries, text_queries  # noqa: F401
