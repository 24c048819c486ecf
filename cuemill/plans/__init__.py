"""Whole jobs, and the queries over the test tables."""

from cuemill.plans import corpus_queries, document_queries, rolling_queries, store_queries, track_queries  # noqa: F401  they register themselves
