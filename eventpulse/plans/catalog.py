"""All registered queries of the event operators, and their SQL."""

from __future__ import annotations

from . import geo_flow_queries, match_record_queries, mention_queries, metric_queries, text_queries

QUERIES = text_queries.QUERIES | match_record_queries.QUERIES | metric_queries.QUERIES | geo_flow_queries.QUERIES | mention_queries.QUERIES
SQL = text_queries.SQL | match_record_queries.SQL | metric_queries.SQL | geo_flow_queries.SQL | mention_queries.SQL
