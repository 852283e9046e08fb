"""All queries of this subpackage, with their SQL."""

from __future__ import annotations

from . import corpus_queries, linkage_queries, ranking_queries, reading_queries, survivor_queries, text_form_queries, variant_queries

_MODULES = [ranking_queries, text_form_queries, linkage_queries, variant_queries, survivor_queries, corpus_queries, reading_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
