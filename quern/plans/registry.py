"""Queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import code_queries, history_queries, phrase_queries, report_queries, selection_queries, text_queries

QUERIES = {**text_queries.QUERIES, **history_queries.QUERIES, **phrase_queries.QUERIES, **report_queries.QUERIES, **selection_queries.QUERIES, **code_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **history_queries.ORACLES, **phrase_queries.ORACLES, **report_queries.ORACLES, **selection_queries.ORACLES, **code_queries.ORACLES}
