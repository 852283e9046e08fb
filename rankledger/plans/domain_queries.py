"""Arbitration, identity, integrity and relational queries over the domain tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import time
from ..operators import arbitration, checks, identity
from ..runtime import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def distinct(spark: SparkSession, sf: str, name: str, *columns) -> DataFrame:
    return table(spark, sf, name).select(*columns).distinct()


# Source arbitration --------------------------------------------------------------------------------------------------

GROUP = ["edition_id", "event_id", "event_division"]
_PREC = "CASE s.source_class WHEN 'structured-official-export' THEN 4 WHEN 'organizer-json-csv' THEN 3 WHEN 'organizer-html-pdf' THEN 2 WHEN 'written-authorized-feed' THEN 1 ELSE 0 END"


def sets_to_arbitrate(spark: SparkSession, sf: str) -> DataFrame:
    """Result sets with their snapshot; content is the digest of each set's placed entries."""
    sets = distinct(spark, sf, "result_sets", "id", "snapshot_id", *GROUP, "published_at", "explicit_final", "correction").where("event_id IS NOT NULL AND edition_id IS NOT NULL")
    shots = distinct(spark, sf, "snapshots", F.col("id").alias("snapshot_id"), "source_class", "permission", "descriptor_permission")
    rows = distinct(spark, sf, "results", F.col("result_set_id").alias("id"), "source_entry_id", "placement").where("placement IS NOT NULL")
    content = rows.groupBy("id").agg(F.sum(F.expr("cast(conv(substring(md5(concat_ws('|', source_entry_id, placement)), 1, 12), 16, 10) as bigint)")).cast("bigint").alias("content"))
    df = sets.join(shots, "snapshot_id", "left").join(content, "id", "left")
    return df.withColumns({
        "valid": F.col("source_class").isNotNull() & F.col("permission").eqNullSafe(F.col("descriptor_permission")), "explicit_final": F.coalesce(F.col("explicit_final") == 1, F.lit(False)),
        "correction": F.coalesce(F.col("correction") == 1, F.lit(False)), "prec": arbitration.precedence(F.col("source_class")), "instant": time.instant(F.col("published_at")), "content": F.coalesce("content", F.lit(0)),
    })


_SETS = f"""WITH src AS (
  SELECT r.*, s.source_class IS NOT NULL AND s.permission IS NOT DISTINCT FROM s.descriptor_permission AS valid, coalesce({_PREC}, 0) AS prec, TRY_CAST(published_at AS TIMESTAMPTZ) AS instant, coalesce(c.content, 0) AS content, coalesce(explicit_final = 1, false) AS ef, coalesce(correction = 1, false) AS co
  FROM (SELECT DISTINCT id, snapshot_id, edition_id, event_id, event_division, published_at, explicit_final, correction FROM result_sets WHERE event_id IS NOT NULL AND edition_id IS NOT NULL) r
  LEFT JOIN (SELECT DISTINCT id, source_class, permission, descriptor_permission FROM snapshots) s ON s.id = r.snapshot_id
  LEFT JOIN (SELECT id, CAST(sum(CAST('0x' || substr(md5(source_entry_id || '|' || placement), 1, 12) AS BIGINT)) AS BIGINT) AS content FROM (SELECT DISTINCT result_set_id AS id, source_entry_id, placement FROM results WHERE placement IS NOT NULL) GROUP BY 1) c ON c.id = r.id),
  q AS (SELECT * FROM src WHERE valid AND (ef OR co)),
  p AS (SELECT * FROM q QUALIFY prec = max(prec) OVER (PARTITION BY edition_id, event_id, event_division)),
  f AS (SELECT * FROM p QUALIFY ef OR NOT bool_or(ef) OVER (PARTITION BY edition_id, event_id, event_division)),
  d AS (SELECT * FROM f QUALIFY instant = max(instant) OVER (PARTITION BY edition_id, event_id, event_division)),
  g AS (SELECT edition_id, event_id, event_division, count(DISTINCT content) > 1 AS conflict, min(snapshot_id) AS win FROM d GROUP BY 1, 2, 3)
"""


@query(_SETS + """SELECT src.id, CASE WHEN NOT valid THEN 'INVALID' WHEN NOT (ef OR co) THEN 'NONFINAL' WHEN src.id NOT IN (SELECT id FROM p) THEN 'LOWER_PRECEDENCE' WHEN src.id NOT IN (SELECT id FROM d) THEN 'SUPERSEDED'
  WHEN coalesce(conflict, false) THEN 'CONFLICT_WITHHELD' WHEN snapshot_id <> win THEN 'DUPLICATE_CONTENT' END AS reason, CASE WHEN NOT coalesce(conflict, false) THEN win END AS selected_snapshot_id
  FROM src LEFT JOIN g ON src.edition_id = g.edition_id AND src.event_id = g.event_id AND src.event_division IS NOT DISTINCT FROM g.event_division""")
def win_03_arbitrate(spark: SparkSession, sf: str) -> DataFrame:
    return arbitration.arbitrate(sets_to_arbitrate(spark, sf), GROUP).select("id", "reason", "selected_snapshot_id")


@query("""WITH src AS (
 SELECT CAST(o_custkey AS BIGINT) AS group_id, CAST(o_orderkey AS BIGINT) AS snapshot_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS precedence,
  o_orderstatus = 'F' AS explicit_final, o_orderstatus = 'P' AS correction, year(o_orderdate) AS published_at,
  CAST(floor(o_totalprice / 100000) AS INT) AS content FROM orders),
q AS (SELECT * FROM src WHERE explicit_final OR correction),
p AS (SELECT *, max(precedence) OVER (PARTITION BY group_id) AS mp FROM q),
f AS (SELECT *, max(CASE WHEN explicit_final THEN 1 ELSE 0 END) OVER (PARTITION BY group_id) AS anyf FROM p WHERE precedence = mp),
n AS (SELECT *, max(published_at) OVER (PARTITION BY group_id) AS newest FROM f WHERE anyf = 0 OR explicit_final),
dcs AS (SELECT * FROM n WHERE published_at = newest),
g AS (SELECT group_id, count(DISTINCT content) AS contents, min(snapshot_id) AS winner FROM dcs GROUP BY group_id)
SELECT group_id, CASE WHEN contents > 1 THEN NULL ELSE winner END AS selected_snapshot_id, contents > 1 AS conflict FROM g""")
def agg_04_agg_05_decide(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("snapshot_id"), F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END").alias("prec"),
        (F.col("o_orderstatus") == "F").alias("explicit_final"), (F.col("o_orderstatus") == "P").alias("correction"), F.year("o_orderdate").alias("instant"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("content"), F.lit(True).alias("valid"))
    done = arbitration.arbitrate(o, ["group_id"]).where("explicit_final OR correction")
    return done.groupBy("group_id").agg(F.max("selected_snapshot_id").alias("selected_snapshot_id"), F.max("conflict").alias("conflict"))


@query("""SELECT edition_id, event_id, event_division, count(DISTINCT coalesce(event_name, chr(1)) || '|' || coalesce(CAST(event_eligible AS VARCHAR), '')) = 1 AS agrees, count(*) AS sets FROM (SELECT DISTINCT id, edition_id, event_id, event_division, event_name, event_eligible FROM result_sets) GROUP BY 1, 2, 3""")
def agg_03_metadata_agrees(spark: SparkSession, sf: str) -> DataFrame:
    return arbitration.metadata_agrees(distinct(spark, sf, "result_sets", "id", *GROUP, "event_name", "event_eligible"), GROUP, ["event_name", "event_eligible"])


@query("""SELECT r.id, CASE WHEN s.id IS NULL THEN 'SOURCE_REFERENCE_INVALID' WHEN s.permission IS DISTINCT FROM s.descriptor_permission OR s.media_type NOT IN ('application/json', 'text/csv', 'text/html') THEN 'SOURCE_PERMISSION_MISMATCH' END AS reason
  FROM (SELECT DISTINCT id, snapshot_id FROM result_sets) r LEFT JOIN (SELECT DISTINCT id, permission, descriptor_permission, media_type FROM snapshots) s ON s.id = r.snapshot_id""")
def jon_04_flt_08_source_reference(spark: SparkSession, sf: str) -> DataFrame:
    sets = distinct(spark, sf, "result_sets", "id", "snapshot_id")
    shots = distinct(spark, sf, "snapshots", F.col("id").alias("sid"), "permission", "descriptor_permission", "media_type")
    media = F.coalesce(F.col("media_type").isin("application/json", "text/csv", "text/html"), F.lit(True))
    rules = [("SOURCE_REFERENCE_INVALID", F.col("sid").isNotNull()), ("SOURCE_PERMISSION_MISMATCH", F.col("permission").eqNullSafe(F.col("descriptor_permission")) & media)]
    return sets.join(shots, sets["snapshot_id"] == shots["sid"], "left").select("id", checks.first_failure(rules).alias("reason"))


@query("""SELECT r.result_set_id, bool_and(r.division IS NOT DISTINCT FROM s.event_division) AS agrees, count(*) AS results FROM (SELECT DISTINCT id, result_set_id, division FROM results) r JOIN (SELECT DISTINCT id, event_division FROM result_sets) s ON s.id = r.result_set_id GROUP BY 1""")
def flt_10_division_agrees(spark: SparkSession, sf: str) -> DataFrame:
    r, s = distinct(spark, sf, "results", "id", "result_set_id", "division"), distinct(spark, sf, "result_sets", F.col("id").alias("result_set_id"), "event_division")
    return r.join(s, "result_set_id").groupBy("result_set_id").agg(F.bool_and(F.col("division").eqNullSafe(F.col("event_division"))).alias("agrees"), F.count(F.lit(1)).alias("results"))


@query("SELECT count(*) FILTER (explicit_final = 1 OR correction = 1) AS qualified, count(*) FILTER (NOT coalesce(explicit_final = 1 OR correction = 1, false)) AS nonfinal, season_id FROM (SELECT DISTINCT r.id, explicit_final, correction, e.season_id FROM result_sets r JOIN (SELECT DISTINCT id, season_id FROM editions) e ON e.id = r.edition_id) GROUP BY season_id")
def flt_11_jon_23_qualified(spark: SparkSession, sf: str) -> DataFrame:
    r, e = distinct(spark, sf, "result_sets", "id", "edition_id", "explicit_final", "correction"), distinct(spark, sf, "editions", F.col("id").alias("edition_id"), "season_id")
    final = F.coalesce((F.col("explicit_final") == 1) | (F.col("correction") == 1), F.lit(False))
    return r.join(e, "edition_id").select("id", "explicit_final", "correction", "season_id").distinct().groupBy("season_id").agg(F.count_if(final).alias("qualified"), F.count_if(~final).alias("nonfinal"))


# Identity ------------------------------------------------------------------------------------------------------------


@query("SELECT p_name AS name, p_brand AS school, CAST(count(*) AS BIGINT) AS people, CAST(min(p_partkey) AS BIGINT) AS root FROM part GROUP BY p_name, p_brand")
def jon_15_exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    g = identity.exact_groups(p, ["p_name", "p_brand"], "p_partkey").join(p, "p_partkey")
    return g.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("school")).agg(F.count(F.lit(1)).alias("people"), F.min("root").alias("root"))


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS prev FROM customer),
b AS (SELECT *, sum(CASE WHEN prev IS NULL OR c_acctbal - prev > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a)
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey, island) AS BIGINT) AS component FROM b""")
def grf_01_components(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    c = table(spark, sf, "customer").withColumns({"_pk": F.lag("c_custkey").over(w), "_pb": F.lag("c_acctbal").over(w)})
    near = F.when(F.col("c_acctbal") - F.col("_pb") <= 50, F.col("_pk")).otherwise(F.col("c_custkey"))
    return identity.connected(c.select(F.col("c_custkey").alias("a"), near.alias("b")))


@query("""WITH e AS (SELECT DISTINCT source_person_key AS k, competitor_id AS c FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL)
  SELECT k, c FROM e WHERE k IN (SELECT k FROM e GROUP BY 1 HAVING count(*) = 1) AND c IN (SELECT c FROM e GROUP BY 1 HAVING count(*) = 1)""")
def grf_06_mutual_unique(spark: SparkSession, sf: str) -> DataFrame:
    e = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("k"), F.col("competitor_id").alias("c")).where("k IS NOT NULL AND c IS NOT NULL")
    return identity.mutual_unique(e, "k", "c")


@query("""SELECT DISTINCT source_person_key AS k FROM (SELECT source_person_key, edition_id, event_key FROM results WHERE source_person_key IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT source_entry_id) > 1)""")
def grf_07_jon_18_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("source_person_key IS NOT NULL").select(F.col("source_person_key").alias("k"), F.to_json(F.struct("edition_id", "event_key")).alias("event"), "source_entry_id")
    return identity.contradictory(r, "k", "event", "source_entry_id")


@query("""SELECT competitor_id AS component, min(source_person_key) AS seed, 'competitor:' || sha256(min(source_person_key)) AS competitor_id, array_to_string(list_sort(list(DISTINCT source_person_key)), ',') AS keys, count(*) AS records
  FROM (SELECT DISTINCT source_person_key, competitor_id FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL) GROUP BY 1""")
def grf_08_hsh_02_materialize(spark: SparkSession, sf: str) -> DataFrame:
    m = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("key"), F.col("competitor_id").alias("component")).where("key IS NOT NULL AND component IS NOT NULL")
    return identity.competitors(m, "component", "key", "key", "key").select("component", F.col("display").alias("seed"), "competitor_id", F.array_join("keys", ",").alias("keys"), "records")


@query("""WITH e AS (SELECT DISTINCT source_person_key AS k, competitor_id AS c FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL),
  amb AS (SELECT k FROM e GROUP BY 1 HAVING count(*) > 1), hit AS (SELECT DISTINCT c FROM e WHERE k IN (SELECT k FROM amb)) SELECT DISTINCT e.k, e.c FROM e JOIN hit USING (c)""")
def grf_09_jon_09_scope(spark: SparkSession, sf: str) -> DataFrame:
    e = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("k"), F.col("competitor_id").alias("c")).where("k IS NOT NULL AND c IS NOT NULL")
    shared = e.groupBy("k").count().where("count > 1").select("k")
    return e.join(e.join(shared, "k", "left_semi").select("c").distinct(), "c", "left_semi").select("k", "c")


# Joins, aggregates, windows ------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT source_person_key AS k, min(competitor_id) AS c, count(*) AS n FROM (SELECT DISTINCT source_person_key, competitor_id FROM identity_matches WHERE competitor_id IS NOT NULL) GROUP BY 1)
  SELECT r.id, CASE WHEN n = 1 THEN c END AS competitor_id, coalesce(n, 0) AS matches FROM (SELECT DISTINCT id, source_person_key FROM results) r LEFT JOIN k ON r.source_person_key IS NOT DISTINCT FROM k.k""")
def jon_06_exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "results", "id", "source_person_key")
    m = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("k"), "competitor_id").where("competitor_id IS NOT NULL")
    return checks.exactly_one(r, m, [("source_person_key", "k")], "competitor_id").select("id", "competitor_id", "matches")


@query("""SELECT DISTINCT a.id FROM awards a WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.parent_table = 'editions' AND t.row_id = a.edition_id) AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.parent_table = 'snapshots' AND t.row_id = a.snapshot_id)""")
def jon_08_anti_either(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tombstones")
    gone = lambda parent, key: t.where(F.col("parent_table") == parent).select(F.col("row_id").alias(key))
    return table(spark, sf, "awards").select("id", "edition_id", "snapshot_id").join(gone("editions", "edition_id"), "edition_id", "left_anti").join(gone("snapshots", "snapshot_id"), "snapshot_id", "left_anti").select("id").distinct()


@query("SELECT e.id, max(s.retrieved_at) AS last_retrieved, count(s.id) AS snapshots FROM (SELECT DISTINCT id FROM editions) e LEFT JOIN (SELECT DISTINCT id, edition_id, retrieved_at FROM snapshots) s ON s.edition_id = e.id GROUP BY 1")
def jon_20_agg_12_latest_left(spark: SparkSession, sf: str) -> DataFrame:
    s = distinct(spark, sf, "snapshots", "id", "edition_id", "retrieved_at").groupBy("edition_id").agg(F.max("retrieved_at").alias("last_retrieved"), F.count("id").alias("snapshots"))
    e = distinct(spark, sf, "editions", "id")
    return e.join(s, e["id"] == s["edition_id"], "left").select("id", "last_retrieved", F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


@query("SELECT DISTINCT s.id, s.descriptor_id, d.n FROM snapshots s JOIN (SELECT descriptor_id, source_class, count(DISTINCT id) AS n FROM snapshots GROUP BY 1, 2) d ON d.descriptor_id = s.descriptor_id AND d.source_class = s.source_class")
def jon_21_composite(spark: SparkSession, sf: str) -> DataFrame:
    s = distinct(spark, sf, "snapshots", "id", "descriptor_id", "source_class")
    return s.join(s.groupBy("descriptor_id", "source_class").agg(F.count(F.lit(1)).alias("n")), ["descriptor_id", "source_class"]).select("id", "descriptor_id", "n")


@query("""SELECT e.id, e.tier, l.canonical_name, s.sid, s.retrieved_at, s.source_class FROM (SELECT DISTINCT id, lineage_id, tier FROM editions) e LEFT JOIN (SELECT id, min(canonical_name) AS canonical_name FROM lineages GROUP BY 1) l ON l.id = e.lineage_id
  LEFT JOIN (SELECT DISTINCT edition_id, id AS sid, retrieved_at, source_class FROM snapshots WHERE edition_id IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY edition_id ORDER BY TRY_CAST(retrieved_at AS TIMESTAMPTZ) DESC NULLS LAST, id DESC) = 1) s ON s.edition_id = e.id""")
def jon_22_win_10_edition_index(spark: SparkSession, sf: str) -> DataFrame:
    e = distinct(spark, sf, "editions", "id", "lineage_id", "tier")
    names = table(spark, sf, "lineages").groupBy(F.col("id").alias("lineage_id")).agg(F.min("canonical_name").alias("canonical_name"))
    s = distinct(spark, sf, "snapshots", "edition_id", F.col("id").alias("sid"), "retrieved_at", "source_class").where("edition_id IS NOT NULL").withColumn("_t", time.instant(F.col("retrieved_at")))
    newest = checks.latest(s, ["edition_id"], ["_t", "sid"])
    return e.join(names, "lineage_id", "left").join(newest, e["id"] == newest["edition_id"], "left").select("id", "tier", "canonical_name", "sid", "retrieved_at", "source_class")


@query("SELECT DISTINCT a.id, r.points AS standing_points FROM awards a JOIN (SELECT standings_version_id AS v, competitor_id AS c, max(points) AS points FROM standing_rows GROUP BY 1, 2) r ON r.v = a.standings_version_id AND r.c = a.competitor_id")
def jon_26_award_standing(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "standing_rows").groupBy("standings_version_id", "competitor_id").agg(F.max("points").alias("standing_points"))
    return distinct(spark, sf, "awards", "id", "standings_version_id", "competitor_id").join(r, ["standings_version_id", "competitor_id"]).select("id", "standing_points")


@query("SELECT n.n_nationkey, count(DISTINCT c.c_custkey) AS shared FROM nation n LEFT JOIN (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def jon_30_set_01_semi_count(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    n = table(spark, sf, "nation").select("n_nationkey")
    g = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("shared"))
    return n.join(g, n["n_nationkey"] == g["c_nationkey"], "left").select("n_nationkey", F.coalesce("shared", F.lit(0)).alias("shared"))


@query("""WITH a AS (SELECT competitor_id, max(points) AS points, max(wins) AS wins FROM standing_rows WHERE standings_version_id <= 'sv-000000050' GROUP BY 1), b AS (SELECT competitor_id, max(points) AS points, max(wins) AS wins FROM standing_rows WHERE standings_version_id > 'sv-000000050' GROUP BY 1)
  SELECT competitor_id, status, CASE WHEN status = 'differs' THEN array_to_string(list_filter([CASE WHEN ap IS DISTINCT FROM bp THEN 'points' END, CASE WHEN aw IS DISTINCT FROM bw THEN 'wins' END], lambda x: x IS NOT NULL), ',') END AS fields FROM (
  SELECT competitor_id, a.points AS ap, b.points AS bp, a.wins AS aw, b.wins AS bw, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.points IS DISTINCT FROM b.points OR a.wins IS DISTINCT FROM b.wins THEN 'differs' END AS status
  FROM (SELECT *, 1 AS k FROM a) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (competitor_id)) WHERE status IS NOT NULL""")
def jon_32_full_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "standing_rows")
    side = lambda cond: s.where(cond).groupBy("competitor_id").agg(F.max("points").alias("points"), F.max("wins").alias("wins"))
    return checks.full_diff(side("standings_version_id <= 'sv-000000050'"), side("standings_version_id > 'sv-000000050'"), ["competitor_id"], ["points", "wins"]).withColumn("fields", F.array_join("fields", ","))


@query("SELECT DISTINCT source_person_key AS k FROM results WHERE won_final_round = 1 AND source_person_key IS NOT NULL AND source_person_key NOT IN (SELECT source_person_key FROM identity_matches WHERE source_person_key IS NOT NULL)")
def jon_33_jon_34_set_07_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "identity_matches").where("source_person_key IS NOT NULL").select(F.col("source_person_key").alias("k"))
    return table(spark, sf, "results").where("won_final_round = 1 AND source_person_key IS NOT NULL").select(F.col("source_person_key").alias("k")).subtract(have)


@query("SELECT edition_id, count(*) FILTER (furthest_stage = 'final') AS finals, count(*) FILTER (placement IS NULL) AS unplaced, count(*) AS results, count(DISTINCT source_person_key) AS persons FROM (SELECT DISTINCT id, edition_id, furthest_stage, placement, source_person_key FROM results) GROUP BY 1")
def agg_06_agg_09_agg_10_edition_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "results", "id", "edition_id", "furthest_stage", "placement", "source_person_key")
    counts = r.groupBy("edition_id").agg(F.count_if(F.col("furthest_stage") == "final").alias("finals"), F.count_if(F.col("placement").isNull()).alias("unplaced"), F.count(F.lit(1)).alias("results"))
    persons = r.where("source_person_key IS NOT NULL").select("edition_id", "source_person_key").distinct().groupBy("edition_id").agg(F.count(F.lit(1)).alias("persons"))
    on = counts["edition_id"].eqNullSafe(persons["edition_id"])
    return counts.join(persons, on, "left").select(counts["edition_id"], "finals", "unplaced", "results", F.coalesce("persons", F.lit(0)).alias("persons"))


@query("SELECT (SELECT count(*) FROM editions) + (SELECT count(*) FROM snapshots) + (SELECT count(*) FROM awards) AS blockers")
def agg_13_sum_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda t: table(spark, sf, t).agg(F.count(F.lit(1)).alias("n"))
    return n("editions").unionAll(n("snapshots")).unionAll(n("awards")).agg(F.sum("n").alias("blockers"))


@query("SELECT r.edition_id, coalesce(max(r.published_at) FILTER (r.explicit_final = 1), any_value(e.start_at)) AS published FROM result_sets r LEFT JOIN (SELECT DISTINCT id, start_at FROM editions) e ON e.id = r.edition_id GROUP BY 1")
def agg_14_agg_15_max_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "result_sets").groupBy("edition_id").agg(F.max(F.when(F.col("explicit_final") == 1, F.col("published_at"))).alias("last"))
    e = distinct(spark, sf, "editions", "id", "start_at")
    return r.join(e, r["edition_id"] == e["id"], "left").select("edition_id", F.coalesce("last", "start_at").alias("published"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_16_val_01_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT edition_id, array_to_string(list_sort(list(DISTINCT division)), ',') AS divisions FROM results GROUP BY 1")
def agg_17_sorted_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").groupBy("edition_id").agg(F.array_join(F.array_sort(F.collect_set("division")), ",").alias("divisions"))


@query("SELECT published_name, max(n) > 1 AS repeated FROM (SELECT published_name, edition_id, event_key, division, count(DISTINCT source_entry_id) AS n FROM results WHERE published_name IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1")
def agg_18_dup_participation(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("published_name IS NOT NULL")
    n = r.groupBy("published_name", "edition_id", "event_key", "division").agg((F.coalesce(F.min("source_entry_id") != F.max("source_entry_id"), F.lit(False))).alias("several"))
    return n.groupBy("published_name").agg(F.max("several").alias("repeated"))


@query("SELECT competitor_id, metric, sum(v) AS total FROM (SELECT competitor_id, unnest(['points', 'wins', 'finals']) AS metric, unnest([points, wins, finals]) AS v FROM standing_rows) WHERE v IS NOT NULL GROUP BY 1, 2".replace("sum(v)", "CAST(sum(v) AS BIGINT)"))
def agg_19_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "standing_rows").unpivot("competitor_id", ["points", "wins", "finals"], "metric", "v")
    return u.where("v IS NOT NULL").groupBy("competitor_id", "metric").agg(F.sum("v").alias("total"))


@query("SELECT season_id, count(DISTINCT id) AS editions, (SELECT count(DISTINCT id) FROM lineages) AS lineages, count(DISTINCT id) = (SELECT count(DISTINCT id) FROM lineages) AS complete FROM editions GROUP BY 1")
def agg_21_set_05_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = distinct(spark, sf, "lineages", "id").agg(F.count(F.lit(1)).alias("lineages"))
    e = distinct(spark, sf, "editions", "id", "season_id").groupBy("season_id").agg(F.count(F.lit(1)).alias("editions"))
    return e.select("season_id", "editions", n.scalar().alias("lineages")).withColumn("complete", F.col("editions") == F.col("lineages"))


@query("SELECT id, CASE WHEN bad THEN 'WITHHELD' END AS state, first_bad FROM (SELECT DISTINCT id, max(b) OVER w = 1 AS bad, min(CASE WHEN b = 1 THEN id END) OVER w AS first_bad FROM (SELECT *, CASE WHEN coalesce(placement <= 6 AND furthest_stage IS DISTINCT FROM 'final', false) THEN 1 ELSE 0 END AS b FROM results) WINDOW w AS (PARTITION BY edition_id, event_key))")
def win_04_withhold_event(spark: SparkSession, sf: str) -> DataFrame:
    """One contradictory row withholds its event; flags come from an aggregate joined back, so a hot edition is no hot task."""
    bad = F.coalesce((F.col("placement") <= 6) & ~F.col("furthest_stage").eqNullSafe("final"), F.lit(False))
    r = distinct(spark, sf, "results", "id", "edition_id", "event_key", bad.alias("b"))
    g = r.where("b").groupBy("edition_id", "event_key").agg(F.min("id").alias("first_bad"))
    on = r["edition_id"].eqNullSafe(g["edition_id"]) & r["event_key"].eqNullSafe(g["event_key"])
    return r.join(g, on, "left").select("id", F.when(F.col("first_bad").isNotNull(), "WITHHELD").alias("state"), "first_bad").distinct()


@query("""SELECT season_id, id, row_number() OVER (PARTITION BY season_id ORDER BY TRY_CAST(end_at AS TIMESTAMPTZ) NULLS LAST, lineage_id NULLS LAST, id) AS place, count(*) FILTER (TRY_CAST(end_at AS TIMESTAMPTZ) <= CAST(left(season_id, 4) || '-12-31' AS TIMESTAMPTZ)) OVER (PARTITION BY season_id) AS before_cutoff
  FROM (SELECT DISTINCT season_id, id, end_at, lineage_id FROM editions)""")
def win_05_flt_14_season_order(spark: SparkSession, sf: str) -> DataFrame:
    e = distinct(spark, sf, "editions", "season_id", "id", "end_at", "lineage_id").withColumn("_t", time.instant(F.col("end_at")))
    w = Window.partitionBy("season_id")
    cutoff = F.concat(F.substring("season_id", 1, 4), F.lit("-12-31")).cast("timestamp")
    return e.select("season_id", "id", F.row_number().over(w.orderBy(F.asc_nulls_last("_t"), F.asc_nulls_last("lineage_id"), "id")).cast("bigint").alias("place"), F.count_if(F.col("_t") <= cutoff).over(w).alias("before_cutoff"))


@query("SELECT lineage_id, alias, CAST(min(pos) AS INT) AS pos FROM (SELECT id AS lineage_id, unnest(a) AS alias, unnest(range(len(a))) AS pos FROM (SELECT id, from_json(aliases_json, '[\"VARCHAR\"]') AS a FROM lineages)) WHERE alias IS NOT NULL GROUP BY 1, 2")
def win_09_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineages").select(F.col("id").alias("lineage_id"), F.posexplode(F.from_json("aliases_json", "array<string>")).alias("pos", "alias"))
    return a.where("alias IS NOT NULL").groupBy("lineage_id", "alias").agg(F.min("pos").alias("pos"))


@query("SELECT edition_id, source_entry_id, CAST(max(CASE furthest_stage WHEN 'octafinal' THEN 1 WHEN 'quarterfinal' THEN 2 WHEN 'semifinal' THEN 3 WHEN 'final' THEN 4 END) AS INT) AS depth FROM results GROUP BY 1, 2")
def win_11_furthest_stage(spark: SparkSession, sf: str) -> DataFrame:
    d = F.expr("CASE furthest_stage WHEN 'octafinal' THEN 1 WHEN 'quarterfinal' THEN 2 WHEN 'semifinal' THEN 3 WHEN 'final' THEN 4 END")
    return table(spark, sf, "results").groupBy("edition_id", "source_entry_id").agg(F.max(d).alias("depth"))


@query("SELECT id, start_at, lineage_id, row_number() OVER (PARTITION BY season_id ORDER BY start_at NULLS LAST, lineage_id NULLS LAST, id) AS place FROM (SELECT DISTINCT id, season_id, start_at, lineage_id FROM editions)")
def srt_06_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    e = distinct(spark, sf, "editions", "id", "season_id", "start_at", "lineage_id")
    w = Window.partitionBy("season_id").orderBy(F.asc_nulls_last("start_at"), F.asc_nulls_last("lineage_id"), "id")
    return e.select("id", "start_at", "lineage_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT edition_id, count(*) AS n FROM snapshots WHERE edition_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, edition_id LIMIT 100")
def lim_02_top_hundred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "snapshots").where("edition_id IS NOT NULL").groupBy("edition_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "edition_id").limit(100)


@query("SELECT id, id IN (SELECT edition_id FROM snapshots) AS has_evidence FROM (SELECT DISTINCT id FROM editions)")
def lim_03_exists(spark: SparkSession, sf: str) -> DataFrame:
    have = distinct(spark, sf, "snapshots", F.col("edition_id").alias("id")).where("id IS NOT NULL").withColumn("has_evidence", F.lit(True))
    return distinct(spark, sf, "editions", "id").join(have, "id", "left").select("id", F.coalesce("has_evidence", F.lit(False)).alias("has_evidence"))


@query("SELECT edition_id, id AS current_id FROM (SELECT DISTINCT edition_id, id, TRY_CAST(published_at AS TIMESTAMPTZ) AS t FROM result_sets) QUALIFY row_number() OVER (PARTITION BY edition_id ORDER BY t DESC NULLS LAST, id DESC) = 1")
def lim_04_jon_25_current(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "result_sets", "edition_id", "id", time.instant(F.col("published_at")).alias("t"))
    return r.groupBy("edition_id").agg(F.max_by("id", F.struct("t", "id")).alias("current_id"))


@query("SELECT edition_id, min_by(id, (CASE WHEN right(id, 1) = '7' THEN 0 ELSE 1 END, id)) AS chosen FROM result_sets GROUP BY 1")
def lim_05_preferred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_sets").groupBy("edition_id").agg(F.min_by("id", F.struct(F.when(F.right("id", F.lit(1)) == "7", 0).otherwise(1).alias("p"), "id")).alias("chosen"))


# Set operations ------------------------------------------------------------------------------------------------------


@query("SELECT edition_id FROM awards WHERE edition_id IS NOT NULL INTERSECT SELECT id FROM editions")
def set_01_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "awards").where("edition_id IS NOT NULL").select("edition_id").intersect(table(spark, sf, "editions").select("id"))


@query("SELECT k, CAST(sum(p) AS BIGINT) AS points FROM (SELECT competitor_id AS k, points AS p FROM awards WHERE win = 1 UNION ALL SELECT competitor_id, points FROM awards WHERE final_credit = 1) GROUP BY 1")
def set_02_set_03_union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "awards")
    part = lambda c: a.where(c).select(F.col("competitor_id").alias("k"), "points")
    return part("win = 1").unionByName(part("final_credit = 1")).groupBy("k").agg(F.sum("points").alias("points"))


@query("SELECT descriptor_id, source_class, permission FROM snapshots UNION SELECT descriptor_id, source_class, permission FROM snapshots")
def set_04_distinct_structs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "snapshots").select("descriptor_id", "source_class", "permission").dropDuplicates()


@query("SELECT competitor_id FROM awards WHERE competitor_id IS NOT NULL UNION SELECT competitor_id FROM standing_rows WHERE competitor_id IS NOT NULL")
def set_06_union(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda t: table(spark, sf, t).where("competitor_id IS NOT NULL").select("competitor_id")
    return ids("awards").union(ids("standing_rows")).distinct()


# Further filters, joins and projections ------------------------------------------------------------------------------


@query("SELECT DISTINCT id FROM editions WHERE status IN ('results-discovered', 'awaiting-results', 'provisional', 'final', 'corrected') AND discovered_from IS NOT NULL AND end_at IS NOT NULL")
def flt_17_flt_18_ready_editions(spark: SparkSession, sf: str) -> DataFrame:
    ready = F.col("status").isin("results-discovered", "awaiting-results", "provisional", "final", "corrected")
    return table(spark, sf, "editions").where(ready & F.col("discovered_from").isNotNull() & F.col("end_at").isNotNull()).select("id").distinct()


_LABELS = ["Extemp", "IX", "usx", "United States Extemp", "International  Extemp!"]


@query("SELECT DISTINCT id FROM result_sets WHERE lower(event_name) IN ('extemp', 'ix', 'usx', 'united states extemp', 'international extemp')")
def flt_06_eligible_label(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import exact_key

    labels = F.broadcast(spark.createDataFrame([(x,) for x in _LABELS], "label string").select(exact_key(F.col("label")).alias("k")).distinct())
    return distinct(spark, sf, "result_sets", "id", exact_key(F.col("event_name")).alias("k")).join(labels, "k", "left_semi").select("id")


@query("SELECT count(DISTINCT id) FILTER (event_eligible = 1) AS eligible, count(DISTINCT id) FILTER (event_eligible IS DISTINCT FROM 1) AS rejected, event_division FROM result_sets GROUP BY event_division")
def flt_09_eligible_split(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "result_sets", "id", "event_division", F.coalesce(F.col("event_eligible") == 1, F.lit(False)).alias("e"))
    return r.groupBy("event_division").agg(F.count_if("e").alias("eligible"), F.count_if(~F.col("e")).alias("rejected"))


@query("SELECT edition_id, event_key, count(DISTINCT division) = 1 AND min(division) <> 'combined' AS valid FROM results WHERE edition_id IS NOT NULL AND division IS NOT NULL GROUP BY 1, 2")
def flt_12_division_validity(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("edition_id IS NOT NULL AND division IS NOT NULL").groupBy("edition_id", "event_key").agg(F.min("division").alias("_lo"), F.max("division").alias("_hi"))
    return r.select("edition_id", "event_key", ((F.col("_lo") == F.col("_hi")) & (F.col("_lo") != "combined")).alias("valid"))


@query("""SELECT r.id, k.rule FROM (SELECT DISTINCT id, event_division, correction FROM result_sets) r JOIN (VALUES ('ix', 0, 'ix-plain'), ('usx', 0, 'usx-plain'), ('ix', 1, 'ix-corrected')) k(d, c, rule) ON k.d = r.event_division AND k.c = r.correction""")
def jon_03_rule_join(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("ix", 0, "ix-plain"), ("usx", 0, "usx-plain"), ("ix", 1, "ix-corrected")], "event_division string, correction int, rule string")
    return distinct(spark, sf, "result_sets", "id", "event_division", "correction").join(F.broadcast(rules), ["event_division", "correction"]).select("id", "rule")


@query("""SELECT DISTINCT a.id, a.edition_id, s.source_class, s.sha256, s.parser_version, e.season_id FROM awards a JOIN (SELECT DISTINCT id, source_class, sha256, parser_version FROM snapshots) s ON s.id = a.snapshot_id JOIN (SELECT DISTINCT id, season_id FROM editions) e ON e.id = a.edition_id""")
def prj_06_jon_05_jon_10_provenance(spark: SparkSession, sf: str) -> DataFrame:
    a = distinct(spark, sf, "awards", "id", "edition_id", "snapshot_id")
    s = distinct(spark, sf, "snapshots", F.col("id").alias("snapshot_id"), "source_class", "sha256", "parser_version")
    e = distinct(spark, sf, "editions", F.col("id").alias("edition_id"), "season_id")
    return a.join(s, "snapshot_id").join(e, "edition_id").select("id", "edition_id", "source_class", "sha256", "parser_version", "season_id").distinct()


@query("SELECT DISTINCT e.id, l.canonical_name FROM editions e JOIN lineages l ON l.id = e.lineage_id")
def jon_27_inner_drop_misses(spark: SparkSession, sf: str) -> DataFrame:
    l = distinct(spark, sf, "lineages", F.col("id").alias("lineage_id"), "canonical_name")  # noqa: E741
    return distinct(spark, sf, "editions", "id", "lineage_id").join(l, "lineage_id").select("id", "canonical_name").distinct()


@query("""SELECT id, 'snapshot:' || sha256 AS snapshot_key, '[{"code":"A","snapshot":"snapshot:' || sha256 || '"},{"code":"B","snapshot":"snapshot:' || sha256 || '"}]' AS diagnostics FROM (SELECT DISTINCT id, sha256 FROM snapshots WHERE sha256 IS NOT NULL)""")
def prj_09_rewrite_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The new snapshot id goes into a set and into each of its nested diagnostics."""
    s = distinct(spark, sf, "snapshots", "id", "sha256").where("sha256 IS NOT NULL").withColumn("snapshot_key", F.concat(F.lit("snapshot:"), "sha256"))
    old = F.array(*[F.struct(F.lit(c).alias("code"), F.col("id").alias("snapshot")) for c in "AB"])
    return s.select("id", "snapshot_key", F.to_json(F.transform(old, lambda d: d.withField("snapshot", F.col("snapshot_key")))).alias("diagnostics"))


_LONG = "SELECT competitor_id AS id, any_value(registry_version) AS block, min(display_school || ' / ' || canonical_school_name) AS name FROM competitors GROUP BY 1"


@query(f"""WITH n AS ({_LONG.replace('any_value', 'min')}) SELECT a.id AS left_id, b.id AS right_id FROM n a JOIN n b ON a.block = b.block AND a.id < b.id AND a.name <> b.name AND abs(length(a.name) - length(b.name)) * 50 <= greatest(length(a.name), length(b.name))
  AND greatest(length(a.name), length(b.name)) >= 50 AND levenshtein(a.name, b.name) * 50 <= greatest(length(a.name), length(b.name))""")
def jon_16_similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Long names at least 98 % alike, over all competitors; DuckDB compares every pair of a block."""
    n = table(spark, sf, "competitors").groupBy(F.col("competitor_id").alias("id")).agg(F.min("registry_version").alias("block"), F.min(F.concat("display_school", F.lit(" / "), "canonical_school_name")).alias("name"))
    return identity.similar_pairs(n.where("name IS NOT NULL"), "block", "name", "id").toDF("left_id", "right_id")
