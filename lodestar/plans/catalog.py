"""Imports every module that declares queries."""

from lodestar.plans import cluster_queries, graph_queries, html_queries, matching_queries, search_queries, stream_queries, text_queries  # noqa: F401
