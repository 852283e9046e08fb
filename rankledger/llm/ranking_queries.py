"""Queries of the top-N problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .topn import top_n

SCORES = ["points", "wins", "top_threes", "finals"]
LEADERS = 25


def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "standing_rows")
    return top_n(rows, "standings_version_id", "competitor_id", SCORES, LEADERS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_top(spark, sf_dir).select("standings_version_id", "competitor_id")


_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in SCORES)
_BEST = f"""SELECT standings_version_id, competitor_id, {', '.join(SCORES)} FROM standing_rows WHERE standings_version_id IS NOT NULL AND competitor_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY standings_version_id, competitor_id ORDER BY {_ORDER}) = 1"""
_TOP = f"""SELECT standings_version_id, competitor_id, row_number() OVER (PARTITION BY standings_version_id ORDER BY {_ORDER}, competitor_id) AS position
  FROM ({_BEST}) QUALIFY position <= {LEADERS}"""

QUERIES = {"p1_found": p1_found, "p1_top": p1_top}
ORACLE = {"p1_found": f"SELECT standings_version_id, competitor_id FROM ({_TOP})", "p1_top": _TOP}
