"""Queries of the match-consolidation problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import store, table
from .components import components


def match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_person_key, competitor_id) of both sources; JSON that is no array of strings links nothing."""
    matched = table(spark, sf_dir, "identity_matches").select("source_person_key", "competitor_id")
    listed = table(spark, sf_dir, "competitors").select(F.explode(F.from_json("verified_source_person_keys_json", "array<string>")).alias("source_person_key"), "competitor_id")
    return matched.unionByName(listed).where("source_person_key IS NOT NULL AND competitor_id IS NOT NULL")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group: the smallest competitor id, how many competitors and records it holds."""
    links = store(match_links(spark, sf_dir).distinct(), "links")
    members = store(components(links.df, "source_person_key", "competitor_id", distinct=True), "members").df
    links.drop()
    groups = members.groupBy("_c").agg(F.min(F.when(F.col("_right"), F.col("name"))).alias("group_id"), F.count_if(F.col("_right")).alias("competitors"), F.count(F.lit(1)).alias("records"))
    return members.join(groups, "_c").select(F.col("name").alias("record_key"), "group_id", "competitors", "records")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_groups(spark, sf_dir).where("competitors >= 2").select("record_key", "group_id")


#: A recursive walk along every link; fit for the test sizes only.
_WALK = """WITH RECURSIVE links AS (
    SELECT DISTINCT source_person_key AS k, competitor_id AS c FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL
    UNION SELECT * FROM (SELECT unnest(from_json(verified_source_person_keys_json, '["VARCHAR"]')) AS k, competitor_id AS c FROM competitors) WHERE k IS NOT NULL AND c IS NOT NULL),
  e AS (SELECT k AS a, c AS b FROM links UNION SELECT c, k FROM links),
  walk AS (SELECT c AS root, c AS node FROM links UNION SELECT w.root, e.b FROM walk w JOIN e ON e.a = w.node),
  least_root AS (SELECT node, min(root) AS group_id FROM walk GROUP BY 1),
  sized AS (SELECT group_id, count(*) AS records, count(*) FILTER (node IN (SELECT c FROM links)) AS competitors FROM least_root GROUP BY 1)
"""

QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE = {
    "p3_found": _WALK + "SELECT node AS record_key, group_id FROM least_root JOIN sized USING (group_id) WHERE competitors >= 2",
    "p3_groups": _WALK + "SELECT node AS record_key, group_id, competitors, records FROM least_root JOIN sized USING (group_id)",
}
