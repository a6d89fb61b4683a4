"""Registered queries: each module has QUERIES and the SQL that gives the same rows."""

from tidemark.plans import case_queries, composed_queries, contract_queries, message_queries, page_queries, place_queries, stream_queries, table_queries

MODULES = (page_queries, table_queries, contract_queries, place_queries, case_queries, message_queries, stream_queries, composed_queries)
