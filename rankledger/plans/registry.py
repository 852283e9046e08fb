"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from . import domain_queries, engine_queries, function_queries, orphan_queries, rebuild, rule_queries, source_queries, standings_queries, stream_queries

_MODULES = [standings_queries, function_queries, domain_queries, source_queries, stream_queries, rebuild, orphan_queries, engine_queries, rule_queries]

flagship = standings_queries.agg_01_win_01_standings


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
