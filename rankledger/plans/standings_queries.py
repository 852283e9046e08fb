"""Projected results to awards to ranked standings: the flagship and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, standings
from ..runtime import table


def projected_results(spark: SparkSession, sf_dir: str, places: int = 24) -> DataFrame:
    """orders as placed results: season by August rollover, lineage by key, division by status, place by price."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    o = o.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1).cast("bigint").alias("season_start"),
        (F.col("o_orderkey") % 21).cast("int").alias("lineage_ix"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'ix' WHEN 'O' THEN 'usx' ELSE 'combined' END").alias("division"),
    )
    w = Window.partitionBy("season_start", "lineage_ix", "division").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = o.withColumn("placement", F.row_number().over(w)).where(F.col("placement") <= places)
    stage = F.expr("CASE WHEN placement <= 8 THEN 'final' WHEN placement <= 12 THEN 'semifinal' WHEN placement <= 16 THEN 'quarterfinal' ELSE 'octafinal' END")
    tier = F.expr("CASE WHEN lineage_ix = 0 THEN 1 WHEN lineage_ix <= 3 THEN 2 WHEN lineage_ix <= 7 THEN 3 WHEN lineage_ix <= 14 THEN 4 ELSE 5 END")
    return o.withColumns({"furthest_stage": stage, "tier": tier, "top_six_only": F.col("lineage_ix") == 1, "final_credit_limit": F.when(F.col("lineage_ix") == 1, 5).otherwise(6)})


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinary (non-national) results with points and flags."""
    return scoring.score(projected_results(spark, sf_dir).where("lineage_ix <> 0"))


def max_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = scored_results(spark, sf_dir).where("points > 0")
    return standings.max_per_edition(paid, ["season_start", "lineage_ix"], "o_custkey", tie=["o_orderkey"])


def agg_01_win_01_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = standings.standings(max_awards(spark, sf_dir), ["season_start"], "o_custkey")
    return ranked.select("season_start", F.col("o_custkey").alias("competitor_id"), F.col("standing_rank").cast("int").alias("rnk"), "points", "wins", "top_threes", "finals")


V1_CTES = """WITH o AS (
 SELECT o_orderkey, o_custkey,
  CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season_start,
  CAST(o_orderkey % 21 AS INT) AS lineage_ix,
  CASE o_orderstatus WHEN 'F' THEN 'ix' WHEN 'O' THEN 'usx' ELSE 'combined' END AS division,
  o_totalprice FROM orders),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY season_start, lineage_ix, division ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS placement FROM o),
g AS (SELECT *, CASE WHEN placement <= 8 THEN 'final' WHEN placement <= 12 THEN 'semifinal' WHEN placement <= 16 THEN 'quarterfinal' WHEN placement <= 24 THEN 'octafinal' END AS stage,
   CASE WHEN lineage_ix = 0 THEN 1 WHEN lineage_ix <= 3 THEN 2 WHEN lineage_ix <= 7 THEN 3 WHEN lineage_ix <= 14 THEN 4 ELSE 5 END AS tier FROM p WHERE placement <= 24),
sc AS (SELECT *, CASE
   WHEN lineage_ix = 1 AND placement > 6 THEN 0
   WHEN placement <= 6 THEN CASE tier WHEN 2 THEN CASE placement WHEN 1 THEN 150 WHEN 2 THEN 120 WHEN 3 THEN 105 WHEN 4 THEN 75 WHEN 5 THEN 60 ELSE 50 END
      WHEN 3 THEN CASE placement WHEN 1 THEN 100 WHEN 2 THEN 85 WHEN 3 THEN 70 WHEN 4 THEN 50 WHEN 5 THEN 40 ELSE 33 END
      WHEN 4 THEN CASE placement WHEN 1 THEN 70 WHEN 2 THEN 60 WHEN 3 THEN 49 WHEN 4 THEN 35 WHEN 5 THEN 28 ELSE 23 END
      ELSE CASE placement WHEN 1 THEN 40 WHEN 2 THEN 34 WHEN 3 THEN 28 WHEN 4 THEN 20 WHEN 5 THEN 16 ELSE 13 END END
   WHEN stage IN ('final','semifinal') THEN CASE tier WHEN 2 THEN 38 WHEN 3 THEN 25 WHEN 4 THEN 18 ELSE 0 END
   WHEN stage = 'quarterfinal' THEN CASE tier WHEN 2 THEN 23 WHEN 3 THEN 15 ELSE 0 END
   WHEN stage = 'octafinal' AND tier = 2 THEN 8 ELSE 0 END AS points FROM g WHERE lineage_ix <> 0),
aw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season_start, lineage_ix, o_custkey ORDER BY points DESC, placement ASC, division ASC, o_orderkey ASC) AS rn FROM sc WHERE points > 0) t WHERE rn = 1),
ag AS (SELECT season_start, o_custkey, CAST(SUM(points) AS BIGINT) AS points, CAST(SUM(CASE WHEN placement = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(SUM(CASE WHEN placement <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS top_threes,
  CAST(SUM(CASE WHEN placement <= CASE WHEN lineage_ix = 1 THEN 5 ELSE 6 END THEN 1 ELSE 0 END) AS BIGINT) AS finals FROM aw GROUP BY season_start, o_custkey)
"""

QUERIES = {"agg_01_win_01_standings": agg_01_win_01_standings}
ORACLE = {
    "agg_01_win_01_standings": V1_CTES + "SELECT season_start, o_custkey AS competitor_id, CAST(rank() OVER (PARTITION BY season_start ORDER BY points DESC, wins DESC, top_threes DESC, finals DESC) AS INT) AS rnk, points, wins, top_threes, finals FROM ag",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(V1_CTES + "SELECT o_orderkey, placement, CAST(points AS INT) AS points, placement = 1 AND points > 0 AS win, placement <= 3 AS top_three, placement <= CASE WHEN lineage_ix = 1 THEN 5 ELSE 6 END AS final_credit FROM sc")
def mth_02_jon_11_score_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_results(spark, sf_dir)
    return s.select("o_orderkey", "placement", "points", "win", "top_three", "final_credit")


@query(V1_CTES + "SELECT season_start, lineage_ix, o_custkey, o_orderkey, CAST(points AS INT) AS points, placement FROM aw")
def win_02_flt_13_max_per_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_awards(spark, sf_dir).select("season_start", "lineage_ix", "o_custkey", "o_orderkey", "points", "placement")


@query(V1_CTES + "SELECT season_start, o_custkey, points, position FROM (SELECT *, row_number() OVER (PARTITION BY season_start ORDER BY points DESC, wins DESC, top_threes DESC, finals DESC, o_custkey) AS position FROM ag) WHERE position <= 25")
def lim_01_srt_01_frozen_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = standings.standings(max_awards(spark, sf_dir), ["season_start"], "o_custkey")
    return standings.frozen_top(s, ["season_start"], 25, ["o_custkey"]).select("season_start", "o_custkey", "points", F.col("position").cast("bigint").alias("position"))


_NATIONAL = """, top25 AS (SELECT season_start, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY season_start ORDER BY points DESC, wins DESC, top_threes DESC, finals DESC, o_custkey) AS n FROM ag) WHERE n <= 25),
 nat AS (SELECT * FROM (SELECT *, CASE WHEN placement <= 8 THEN 'final' WHEN placement <= 12 THEN 'semifinal' WHEN placement <= 16 THEN 'quarterfinal' ELSE 'octafinal' END AS stage FROM p WHERE placement <= 24 AND lineage_ix = 0)),
 cnt AS (SELECT n.season_start, n.division, count(DISTINCT n.o_custkey) AS c FROM nat n JOIN top25 t ON t.season_start = n.season_start AND t.o_custkey = n.o_custkey WHERE n.division <> 'combined' GROUP BY 1, 2),
 bonus AS (SELECT season_start, CASE WHEN count(*) FILTER (c = m) = 1 THEN min(division) FILTER (c = m) END AS bonus_division FROM (SELECT *, max(c) OVER (PARTITION BY season_start) AS m FROM cnt) GROUP BY 1)
"""


def national_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_results(spark, sf_dir).where("lineage_ix = 0")


def bonus_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per season the division with more frozen leaders among its national entrants; none on a tie."""
    s = standings.standings(max_awards(spark, sf_dir), ["season_start"], "o_custkey")
    leaders = standings.frozen_top(s, ["season_start"], 25, ["o_custkey"]).select("season_start", "o_custkey")
    field = national_results(spark, sf_dir).where("division <> 'combined'").select("season_start", "division", "o_custkey").distinct()
    n = field.join(leaders, ["season_start", "o_custkey"], "left_semi").groupBy("season_start", "division").agg(F.count(F.lit(1)).alias("c"))
    best = n.groupBy("season_start").agg(F.max("c").alias("c"))
    return n.join(best, ["season_start", "c"]).groupBy("season_start").agg(F.min("division").alias("_d"), F.count(F.lit(1)).alias("_n")).select("season_start", F.when(F.col("_n") == 1, F.col("_d")).alias("bonus_division"))


@query(V1_CTES + _NATIONAL + "SELECT season_start, bonus_division FROM bonus")
def jon_30_agg_06_bonus_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bonus_divisions(spark, sf_dir)


@query(V1_CTES + _NATIONAL + """SELECT o_orderkey, CAST(CASE WHEN strong THEN (base * 5 + 2) // 4 + CASE WHEN placement = 1 THEN 50 ELSE 0 END ELSE base + CASE WHEN placement = 1 THEN 40 ELSE 0 END END AS INT) AS points,
  CASE WHEN strong THEN 'nsda-strong-field' ELSE 'nsda-base' END || CASE WHEN placement = 1 THEN '-final-round-winner' ELSE '' END AS scoring_rule
  FROM (SELECT o_orderkey, placement, coalesce(division = bonus_division, false) AS strong, CASE WHEN placement <= 14 THEN list_extract([200,170,140,100,80,66,50,48,46,44,40,38,36,34], placement) WHEN stage = 'quarterfinal' THEN 30 WHEN stage = 'octafinal' THEN 10 ELSE 0 END AS base FROM nat LEFT JOIN bonus USING (season_start))""")
def mth_03_score_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = national_results(spark, sf_dir).join(bonus_divisions(spark, sf_dir), "season_start", "left").withColumn("won_final_round", F.col("placement") == 1)
    return scoring.score_national(rows).select("o_orderkey", "points", "scoring_rule")


@query("""WITH g AS (SELECT t AS tier, p AS placement FROM range(2, 6) a(t), range(1, 9) b(p)) SELECT CAST(tier AS INT) AS tier, CAST(placement AS INT) AS placement, CASE WHEN placement > 6 THEN CASE tier WHEN 2 THEN 38 WHEN 3 THEN 25 WHEN 4 THEN 18 ELSE 0 END
  ELSE list_extract(CASE tier WHEN 2 THEN [150,120,105,75,60,50] WHEN 3 THEN [100,85,70,50,40,33] WHEN 4 THEN [70,60,49,35,28,23] ELSE [40,34,28,20,16,13] END, placement) END AS points FROM g""")
def mth_04_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(2, 6).select(F.col("id").cast("int").alias("tier"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("placement"))
    g = g.withColumns({"furthest_stage": F.lit("final"), "top_six_only": F.lit(False), "final_credit_limit": F.lit(6)})
    return scoring.score(g).select("tier", "placement", "points")


@query("SELECT standings_version_id, competitor_id, points, rank() OVER (PARTITION BY standings_version_id ORDER BY points DESC, wins DESC, top_threes DESC, finals DESC) AS standing_rank FROM (SELECT DISTINCT standings_version_id, competitor_id, points, wins, top_threes, finals FROM standing_rows WHERE points IS NOT NULL AND wins IS NOT NULL AND top_threes IS NOT NULL AND finals IS NOT NULL)")
def win_01_competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "standing_rows").select("standings_version_id", "competitor_id", *standings.METRICS).dropna(subset=standings.METRICS).distinct()
    return standings.competition_rank(r, ["standings_version_id"]).select("standings_version_id", "competitor_id", "points", "standing_rank")


@query("""SELECT standings_version_id, competitor_id, CAST(standing_rank AS BIGINT) AS published, r AS computed FROM (SELECT *, rank() OVER (PARTITION BY standings_version_id ORDER BY points DESC NULLS LAST, wins DESC NULLS LAST, top_threes DESC NULLS LAST, finals DESC NULLS LAST) AS r FROM (SELECT DISTINCT standings_version_id, competitor_id, standing_rank, points, wins, top_threes, finals FROM standing_rows)) WHERE standing_rank <> r""")
def win_12_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "standing_rows").select("standings_version_id", "competitor_id", "standing_rank", *[F.coalesce(m, F.lit(-(2**31))).alias(m) for m in standings.METRICS]).distinct()
    ranked = standings.competition_rank(r.withColumnRenamed("standing_rank", "published"), ["standings_version_id"])
    return ranked.where("published <> standing_rank").select("standings_version_id", "competitor_id", F.col("published").cast("bigint").alias("published"), F.col("standing_rank").alias("computed"))


@query("SELECT standings_version_id, competitor_id, row_number() OVER (PARTITION BY standings_version_id ORDER BY standing_rank NULLS LAST, competitor_id) AS place FROM (SELECT standings_version_id, competitor_id, min(standing_rank) AS standing_rank FROM standing_rows GROUP BY 1, 2)")
def srt_02_published_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = table(spark, sf_dir, "standing_rows").groupBy("standings_version_id", "competitor_id").agg(F.min("standing_rank").alias("standing_rank"))
    w = Window.partitionBy("standings_version_id").orderBy(F.asc_nulls_last("standing_rank"), "competitor_id")
    return r.select("standings_version_id", "competitor_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT edition_id, event_id, competitor_id, max(points) AS points FROM awards WHERE edition_id IS NOT NULL GROUP BY 1, 2, 3 ORDER BY 1, 2, 3")
def srt_03_award_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "awards").where("edition_id IS NOT NULL").groupBy("edition_id", "event_id", "competitor_id").agg(F.max("points").alias("points")).orderBy("edition_id", "event_id", "competitor_id")


@query("""SELECT result_set_id, id, row_number() OVER (PARTITION BY result_set_id ORDER BY CASE WHEN placement > 0 THEN placement END NULLS LAST, source_entry_id NULLS LAST, id) AS place FROM (SELECT DISTINCT result_set_id, id, placement, source_entry_id FROM results)""")
def srt_04_placement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions import text

    r = table(spark, sf_dir, "results").select("result_set_id", "id", F.concat(F.col("placement").cast("string"), F.lit("th")).alias("raw"), "source_entry_id").distinct()
    w = Window.partitionBy("result_set_id").orderBy(F.asc_nulls_last(text.numeric_placement(F.col("raw"))), F.asc_nulls_last("source_entry_id"), "id")
    return r.select("result_set_id", "id", F.row_number().over(w).cast("bigint").alias("place"))


@query("""SELECT a.standings_version_id, sha256('[' || string_agg('{"competitor_id":"' || competitor_id || '","points":' || points || '}', ',' ORDER BY competitor_id) || ']') AS content_hash FROM (SELECT standings_version_id, competitor_id, max(points) AS points FROM standing_rows WHERE points IS NOT NULL GROUP BY 1, 2) a GROUP BY 1""")
def agg_20_hsh_01_version_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version's canonical JSON digest; a published version is bounded by its competitors."""
    from ..functions.canon import canonical_json

    r = table(spark, sf_dir, "standing_rows").where("points IS NOT NULL").groupBy("standings_version_id", "competitor_id").agg(F.max("points").alias("points"))
    r = r.withColumn("_j", canonical_json(r, ["competitor_id", "points"]))
    items = F.transform(F.array_sort(F.collect_list(F.struct("competitor_id", "_j"))), lambda x: x["_j"])
    return r.groupBy("standings_version_id").agg(F.sha2(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), 256).alias("content_hash"))
