"""The season rebuild as one plan: arbitration, identity, scoring, best award, frozen leaders, national pass, standings.

Two passes over the awards depend on each other: the national events' bonus needs the interim leaders. What both read,
the mapped results and the first pass's awards, is written once; the leaders are at most 25 rows a season and the bonus
one row a season. Nothing is decided on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arbitration, checks, scoring, standings
from ..runtime import store, table
from .domain_queries import GROUP, _SETS, distinct, sets_to_arbitrate

LEADERS = 25


def mapped_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(results of selected sets with competitor, season and tier; diagnostics of those that map to no single one)."""
    selected = arbitration.arbitrate(sets_to_arbitrate(spark, sf), GROUP).where("reason IS NULL").select(F.col("id").alias("result_set_id"), F.col("event_id"))
    rows = distinct(spark, sf, "results", "id", "result_set_id", "edition_id", "source_person_key", "division", "placement", "furthest_stage", "won_final_round").join(selected, "result_set_id")
    matches = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("k"), "competitor_id").where("competitor_id IS NOT NULL AND k IS NOT NULL")
    one = checks.exactly_one(rows, matches, [("source_person_key", "k")], "competitor_id")
    editions = distinct(spark, sf, "editions", F.col("id").alias("edition_id"), "season_id", "tier", "lineage_id")
    placed = one.join(editions, "edition_id")
    lost = placed.where("competitor_id IS NULL").select("id", F.when(F.col("source_person_key").isNull(), "PERSON_MISSING").when(F.col("matches") == 0, "IDENTITY_UNRESOLVED").otherwise("IDENTITY_AMBIGUOUS").alias("code"))
    return placed.where("competitor_id IS NOT NULL").withColumn("won_final_round", F.coalesce(F.col("won_final_round") == 1, F.lit(False))), lost


def withhold_events(scored: DataFrame) -> DataFrame:
    """Drops every event that has a row with an error."""
    bad = scored.where("error_code IS NOT NULL").select("edition_id", "event_id").distinct()
    return scored.join(bad, ["edition_id", "event_id"], "left_anti").where("points > 0")


def best_awards(scored: DataFrame) -> DataFrame:
    return standings.max_per_edition(scored.select("season_id", "edition_id", "competitor_id", "points", "placement", "division", "id", "win", "top_three", "final_credit"), ["season_id", "edition_id"], "competitor_id", tie=["id"])


def rebuild(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """awards, interim, leaders, bonus, standings and diagnostics of all seasons."""
    results, lost = mapped_results(spark, sf)
    results = store(results, "rebuild-results").df  # read by both passes
    ordinary = results.where("tier > 1").withColumns({"top_six_only": F.lit(False), "final_credit_limit": F.lit(6)})
    first = store(best_awards(withhold_events(scoring.score(ordinary))), "rebuild-first").df
    interim = standings.standings(first, ["season_id"], "competitor_id")
    leaders = standings.frozen_top(interim, ["season_id"], LEADERS, ["competitor_id"]).select("season_id", "competitor_id", "position")
    national = results.where("tier = 1 AND division <> 'combined'")
    field = national.select("season_id", "division", "competitor_id").distinct().join(leaders, ["season_id", "competitor_id"], "left_semi").groupBy("season_id", "division").agg(F.count(F.lit(1)).alias("n"))
    most = field.groupBy("season_id").agg(F.max("n").alias("n"))
    bonus = field.join(most, ["season_id", "n"]).groupBy("season_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("division")).alias("bonus_division"))
    second = best_awards(withhold_events(scoring.score_national(national.join(bonus, "season_id", "left"))))
    awards = first.unionByName(second)
    return {"awards": awards, "interim": interim, "leaders": leaders, "bonus": bonus, "standings": standings.standings(awards, ["season_id"], "competitor_id"), "diagnostics": lost}


_PLACED = "CASE tier " + " ".join(f"WHEN {t} THEN list_extract({v}, placement)" for t, v in scoring.PLACEMENT_POINTS.items()) + " END"
_REST = "CASE " + " ".join(f"WHEN tier = {t} AND st = '{s}' THEN {p}" for t, v in scoring.ELIMINATION_POINTS.items() for s, p in v.items()) + " ELSE 0 END"
REBUILD_SQL = _SETS + f""", sel AS (SELECT d.id AS rsid, d.event_id FROM d JOIN g ON d.edition_id = g.edition_id AND d.event_id = g.event_id AND d.event_division IS NOT DISTINCT FROM g.event_division WHERE NOT conflict AND snapshot_id = win),
  im AS (SELECT source_person_key AS k, min(competitor_id) AS c FROM (SELECT DISTINCT source_person_key, competitor_id FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL) GROUP BY 1 HAVING count(*) = 1),
  m AS (SELECT r.id, r.edition_id, sel.event_id, r.division, r.placement, r.furthest_stage AS stage, coalesce(r.won_final_round = 1, false) AS won, im.c, e.season_id, e.tier FROM (SELECT DISTINCT id, result_set_id, edition_id, source_person_key, division, placement, furthest_stage, won_final_round FROM results) r
    JOIN sel ON sel.rsid = r.result_set_id JOIN im ON im.k = r.source_person_key JOIN (SELECT DISTINCT id, season_id, tier, lineage_id FROM editions) e ON e.id = r.edition_id),
  o AS (SELECT *, CASE WHEN stage = 'final' THEN 'semifinal' ELSE stage END AS st, coalesce(placement < 1 OR (placement <= 6 AND stage IS DISTINCT FROM 'final'), false) AS bad FROM m WHERE tier > 1),
  o1 AS (SELECT *, CASE WHEN placement <= 6 THEN {_PLACED} ELSE {_REST} END AS points FROM o WHERE (edition_id, event_id) NOT IN (SELECT (edition_id, event_id) FROM o WHERE bad)),
  a1 AS (SELECT * FROM o1 WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY season_id, edition_id, c ORDER BY points DESC, placement NULLS LAST, division, id) = 1),
  i AS (SELECT season_id, c, sum(points) AS p, count(*) FILTER (placement = 1) AS w, count(*) FILTER (placement <= 3) AS t, count(*) FILTER (placement <= 6) AS f FROM a1 GROUP BY 1, 2),
  lead25 AS (SELECT season_id, c FROM i QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY p DESC, w DESC, t DESC, f DESC, c) <= {LEADERS}),
  fld AS (SELECT season_id, division, count(DISTINCT c) AS n FROM m WHERE tier = 1 AND division <> 'combined' AND (season_id, c) IN (SELECT (season_id, c) FROM lead25) GROUP BY 1, 2),
  bon AS (SELECT season_id, CASE WHEN count(*) = 1 THEN min(division) END AS bd FROM (SELECT * FROM fld QUALIFY n = max(n) OVER (PARTITION BY season_id)) GROUP BY 1),
  n0 AS (SELECT m.*, coalesce(bd = division, false) AS strong, coalesce(placement < 1 OR (placement <= 6 AND stage IS DISTINCT FROM 'final'), false) OR (won AND NOT coalesce(stage = 'final' AND placement BETWEEN 1 AND 6, false)) AS bad,
    coalesce(CASE WHEN placement BETWEEN 1 AND 14 THEN list_extract({scoring.NATIONAL_POINTS}, placement) END, CASE stage WHEN 'quarterfinal' THEN 30 WHEN 'octafinal' THEN 10 ELSE 0 END) AS base FROM m LEFT JOIN bon USING (season_id) WHERE tier = 1 AND division <> 'combined'),
  n1 AS (SELECT *, CASE WHEN strong THEN (base * 5 + 2) // 4 + CASE WHEN won THEN 50 ELSE 0 END ELSE base + CASE WHEN won THEN 40 ELSE 0 END END AS points FROM n0 WHERE (edition_id, event_id) NOT IN (SELECT (edition_id, event_id) FROM n0 WHERE bad)),
  a2 AS (SELECT * FROM n1 WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY season_id, edition_id, c ORDER BY points DESC, placement NULLS LAST, division, id) = 1),
  al AS (SELECT season_id, c, points, placement FROM a1 UNION ALL SELECT season_id, c, points, placement FROM a2),
  tot AS (SELECT season_id, c AS competitor_id, CAST(sum(points) AS BIGINT) AS points, count(*) FILTER (placement = 1) AS wins, count(*) FILTER (placement <= 3) AS top_threes, count(*) FILTER (placement <= 6) AS finals FROM al GROUP BY 1, 2)
"""


def e1_rebuild_standings(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild(spark, sf)["standings"].select("season_id", "competitor_id", "points", "wins", "top_threes", "finals", "standing_rank")


def e1_jon_07_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return mapped_results(spark, sf)[1].groupBy("code").agg(F.count(F.lit(1)).alias("results"))


def prj_07_scoring_input(spark: SparkSession, sf: str) -> DataFrame:
    return mapped_results(spark, sf)[0].select("id", "edition_id", "event_id", "competitor_id", "season_id", "tier", "division", "placement", "furthest_stage", "won_final_round")


QUERIES = {"e1_rebuild_standings": e1_rebuild_standings, "e1_jon_07_diagnostics": e1_jon_07_diagnostics, "prj_07_scoring_input": prj_07_scoring_input}
ORACLE = {
    "prj_07_scoring_input": REBUILD_SQL + "SELECT id, edition_id, event_id, c AS competitor_id, season_id, tier, division, placement, stage AS furthest_stage, won AS won_final_round FROM m",
    "e1_rebuild_standings": REBUILD_SQL + "SELECT *, rank() OVER (PARTITION BY season_id ORDER BY points DESC, wins DESC, top_threes DESC, finals DESC) AS standing_rank FROM tot",
    "e1_jon_07_diagnostics": _SETS + """, sel AS (SELECT d.id AS rsid FROM d JOIN g ON d.edition_id = g.edition_id AND d.event_id = g.event_id AND d.event_division IS NOT DISTINCT FROM g.event_division WHERE NOT conflict AND snapshot_id = win),
  n AS (SELECT source_person_key AS k, count(*) AS n FROM (SELECT DISTINCT source_person_key, competitor_id FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL) GROUP BY 1)
  SELECT code, count(*) AS results FROM (SELECT CASE WHEN source_person_key IS NULL THEN 'PERSON_MISSING' WHEN n.n IS NULL THEN 'IDENTITY_UNRESOLVED' ELSE 'IDENTITY_AMBIGUOUS' END AS code FROM (SELECT DISTINCT id, result_set_id, edition_id, source_person_key FROM results) r
  JOIN sel ON sel.rsid = r.result_set_id JOIN (SELECT DISTINCT id FROM editions) e ON e.id = r.edition_id LEFT JOIN n ON n.k = r.source_person_key WHERE n.n IS DISTINCT FROM 1) GROUP BY 1""",
}


def publish_season(spark: SparkSession, sf: str, season: str, versions, created_at: str) -> tuple[str, bool]:
    """Publishes a season's standings, awards and leaders as a new version; (version, whether it is new).

    The version id is the digest of the standings, so a rebuild that changes nothing publishes nothing.
    """
    from ..functions.canon import table_hash

    out = rebuild(spark, sf)
    own = {k: out[k].where(F.col("season_id") == season) for k in ("standings", "awards", "leaders")}
    digest = table_hash(own["standings"], ["competitor_id", "points", "wins", "top_threes", "finals", "standing_rank"], ["standing_rank", "competitor_id"]).first()[0]
    version = f"standings-{digest[:32]}"
    if versions.unchanged(season, digest):
        return version, False
    return version, versions.publish(version, season, digest, created_at, own)
