"""Queries and oracle SQL of this package, by name."""

from __future__ import annotations

from . import corpus_queries

QUERIES = corpus_queries.QUERIES
ORACLES = corpus_queries.ORACLES
