"""Identity stages, matching, orders, guards and jobs over whole tables, each operator called on inputs that a wrong one would get wrong, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, text, time, url
from ..operators import checks, choices, identity, matching, views
from ..operators import store as stores
from ..runtime import store, table
from ..streaming import jobs
from .function_queries import identity_sql

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


# Identity ------------------------------------------------------------------------------------------------------------

_PEOPLE = "source_person_key IS NOT NULL AND published_name IS NOT NULL AND edition_id IS NOT NULL AND event_key IS NOT NULL AND source_entry_id IS NOT NULL"


def people(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where(_PEOPLE)
    return r.select(F.col("id").alias("person"), "source_person_key", F.split("source_person_key", ":")[0].alias("provider"), F.col("published_name").alias("name"), F.coalesce("published_school", F.lit("")).alias("school"), F.concat_ws("|", "edition_id", "event_key").alias("event"), F.col("source_entry_id").alias("entry")).distinct()


_PEOPLE_SQL = f"""people AS (SELECT DISTINCT id AS person, source_person_key AS k, split_part(source_person_key, ':', 1) AS provider, published_name AS name, coalesce(published_school, '') AS school, edition_id || '|' || event_key AS event, source_entry_id AS entry FROM results WHERE {_PEOPLE})"""


_VARIANT = "SELECT '{v}' AS variant, concat_ws('|', {k}) AS person, arg_max(id, (ingested_at, id)) AS last_id FROM results WHERE {w} GROUP BY {k}"


@query(" UNION ALL ".join(_VARIANT.format(v=v, k=", ".join(k), w=" AND ".join(f"{c} IS NOT NULL" for c in k)) for v, k in identity.PERSON_KEYS.items()))
def prj_08_source_people(spark: SparkSession, sf: str) -> DataFrame:
    """Source people by each of the three keys; of several rows the last to arrive."""
    r = table(spark, sf, "results")
    one = lambda v, k: identity.source_people(r, v, ["ingested_at", "id"]).select(F.lit(v).alias("variant"), F.concat_ws("|", *k).alias("person"), F.col("id").alias("last_id"))
    return reduce(DataFrame.unionByName, [one(v, k) for v, k in identity.PERSON_KEYS.items()])


@query(f"""WITH {_PEOPLE_SQL}, n AS (SELECT k FROM people GROUP BY 1 HAVING count(DISTINCT name) > 1), e AS (SELECT DISTINCT k FROM (SELECT k, event FROM people GROUP BY 1, 2 HAVING count(DISTINCT entry) > 1))
  SELECT DISTINCT k AS source_person_key, CASE WHEN k IN (SELECT k FROM n) THEN 'NAMES_DIFFER' ELSE 'ENTRIES_DIFFER' END AS code FROM people WHERE k IN (SELECT k FROM n) OR k IN (SELECT k FROM e)""")
def grf_02_jon_14_stable_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return identity.stable_conflicts(people(spark, sf), "source_person_key", "name", "event", "entry")


_LINKS = """e AS (SELECT DISTINCT source_person_key AS k, competitor_id AS c FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL),
  links AS (SELECT k AS l, c AS r FROM e UNION ALL SELECT c, k FROM e WHERE k LIKE '%1' UNION ALL SELECT k, k FROM e WHERE k LIKE '%2')"""


@query(f"""WITH {_LINKS}, p AS (SELECT source_person_key AS k FROM results WHERE source_person_key IS NOT NULL UNION SELECT competitor_id FROM competitors WHERE competitor_id IS NOT NULL), d AS (SELECT least(l, r) AS a, greatest(l, r) AS b FROM links GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT DISTINCT l AS left_key, r AS right_key, CASE WHEN l = r THEN 'SELF' WHEN (least(l, r), greatest(l, r)) IN (SELECT (a, b) FROM d) THEN 'DUPLICATE' ELSE 'DANGLING' END AS code FROM links
  WHERE l = r OR (least(l, r), greatest(l, r)) IN (SELECT (a, b) FROM d) OR l NOT IN (SELECT k FROM p) OR r NOT IN (SELECT k FROM p)""")
def grf_03_jon_19_explicit_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of persons to competitors; some come again turned round, some link a key to itself."""
    e = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("left_key"), F.col("competitor_id").alias("right_key")).where("left_key IS NOT NULL AND right_key IS NOT NULL")
    turned = e.where("left_key LIKE '%1'").select(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key"))
    loops = e.where("left_key LIKE '%2'").select("left_key", F.col("left_key").alias("right_key"))
    known = table(spark, sf, "results").select(F.col("source_person_key").alias("key")).unionByName(table(spark, sf, "competitors").select(F.col("competitor_id").alias("key"))).where("key IS NOT NULL")
    return identity.explicit_edge_errors(e.unionByName(turned).unionByName(loops), known, "key")


_LONG = "repeat(display_name || ' ', 5) || CASE WHEN competitor_id LIKE '%0' THEN 'x' ELSE '' END"


@query(f"""WITH c AS (SELECT DISTINCT {_LONG} AS name, canonical_school_id AS school FROM competitors WHERE display_name IS NOT NULL AND canonical_school_id IS NOT NULL), n AS (SELECT name, min(school) AS lo, max(school) AS hi, count(DISTINCT school) AS n FROM c GROUP BY 1)
  SELECT name, name AS other, n AS scopes FROM n WHERE n > 1 UNION ALL SELECT a.name, b.name, 2 FROM n a JOIN n b ON a.name < b.name AND left(a.name, 4) = left(b.name, 4) AND greatest(length(a.name), length(b.name)) >= 50 AND abs(length(a.name) - length(b.name)) * 50 <= greatest(length(a.name), length(b.name))
  AND levenshtein(a.name, b.name) * 50 <= greatest(length(a.name), length(b.name)) WHERE NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)""")
def grf_04_jon_17_cross_school(spark: SparkSession, sf: str) -> DataFrame:
    """Names written five times over, so that one more letter is within the 2 % (a difference in the first letters is five edits, more than 2 %)."""
    c = table(spark, sf, "competitors").where("display_name IS NOT NULL AND canonical_school_id IS NOT NULL").select(F.expr(_LONG).alias("name"), F.col("canonical_school_id").alias("school"), F.col("competitor_id").alias("person")).distinct()
    return identity.similar_across(c, "school", "name", "person")


_WALK = """{name} AS (SELECT node AS root, node FROM {edges}_nodes UNION SELECT w.root, x.b FROM {name} w JOIN {edges}_both x ON x.a = w.node)"""


def _components(name: str, edges: str) -> str:
    """CTEs: {name}(node, component) of the pairs (a, b) in {edges}."""
    return f"""{edges}_both AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), {name}_walk AS (SELECT DISTINCT a AS root, a AS node FROM {edges}_both UNION SELECT w.root, x.b FROM {name}_walk w JOIN {edges}_both x ON x.a = w.node),
  {name} AS (SELECT node, min(root) AS component FROM {name}_walk GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_PEOPLE_SQL}, heads AS (SELECT name, school, min(k) AS h FROM people GROUP BY 1, 2), pairs AS (SELECT DISTINCT k AS a, h AS b FROM people JOIN heads USING (name, school)), {_components('cl', 'pairs')},
  bad AS (SELECT DISTINCT component FROM (SELECT component, event FROM people JOIN cl ON node = k GROUP BY 1, 2 HAVING count(DISTINCT entry) > 1))
  SELECT node AS source_person_key, CASE WHEN component IN (SELECT component FROM bad) THEN node ELSE component END AS merged FROM cl""")
def grf_05_merge_exact(spark: SparkSession, sf: str) -> DataFrame:
    return identity.merge_exact(people(spark, sf), "source_person_key", ["name", "school"], "event", "entry")


def _key_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each key beside the smallest key of one of its competitors."""
    e = distinct(spark, sf, "identity_matches", F.col("source_person_key").alias("right_key"), "competitor_id").where("right_key IS NOT NULL AND competitor_id IS NOT NULL")
    least = e.groupBy("competitor_id").agg(F.min("right_key").alias("left_key"))
    return e.join(least, "competitor_id").where("left_key <> right_key").select("left_key", "right_key").distinct()


_RESOLVE = f"""WITH RECURSIVE {_PEOPLE_SQL}, m AS (SELECT DISTINCT source_person_key AS r, competitor_id AS c FROM identity_matches WHERE source_person_key IS NOT NULL AND competitor_id IS NOT NULL), raw AS (SELECT DISTINCT l, r FROM (SELECT r, min(r) OVER (PARTITION BY c) AS l FROM m) WHERE l <> r),
  known AS (SELECT DISTINCT k FROM people), dangling AS (SELECT l, r FROM raw WHERE l NOT IN (SELECT k FROM known) OR r NOT IN (SELECT k FROM known)), twice AS (SELECT least(l, r) AS x, greatest(l, r) AS y FROM raw GROUP BY 1, 2 HAVING count(*) > 1),
  fine AS (SELECT l AS a, r AS b FROM raw WHERE (l, r) NOT IN (SELECT (l, r) FROM dangling) AND (least(l, r), greatest(l, r)) NOT IN (SELECT (x, y) FROM twice)), {_components('lk', 'fine')},
  at1 AS (SELECT people.*, coalesce(component, k) AS c, component IS NOT NULL AS linked FROM people LEFT JOIN lk ON node = k),
  bad1 AS (SELECT DISTINCT c FROM (SELECT c FROM at1 WHERE linked GROUP BY c, provider HAVING count(DISTINCT k) > 1 UNION SELECT c FROM at1 WHERE linked GROUP BY c, event HAVING count(DISTINCT entry) > 1)),
  at2 AS (SELECT person, k, name, school, event, entry, CASE WHEN c IN (SELECT c FROM bad1) THEN k ELSE c END AS c FROM at1),
  heads AS (SELECT name, school, min(c) AS h FROM at2 GROUP BY 1, 2), pairs AS (SELECT DISTINCT c AS a, h AS b FROM at2 JOIN heads USING (name, school)), {_components('cl', 'pairs')},
  bad2 AS (SELECT DISTINCT component FROM (SELECT component, event FROM at2 JOIN cl ON node = c GROUP BY 1, 2 HAVING count(DISTINCT entry) > 1))"""


@query(_RESOLVE + " SELECT DISTINCT person, 'k:' || CASE WHEN component IN (SELECT component FROM bad2) THEN node ELSE component END AS competitor FROM at2 JOIN cl ON node = c")
def grf_06_resolved_people(spark: SparkSession, sf: str) -> DataFrame:
    """All five stages; the names here are too short for one of the last stage (see its own query and tests)."""
    return identity.resolve(people(spark, sf), _key_links(spark, sf))[0].distinct()


@query(_RESOLVE + """, s AS (SELECT k FROM people GROUP BY 1 HAVING count(DISTINCT name) > 1 UNION SELECT k FROM people GROUP BY k, event HAVING count(DISTINCT entry) > 1)
  SELECT 'STABLE_ID_CONFLICT' AS code, k AS subject FROM s UNION ALL SELECT 'EDGE_DUPLICATE', l || '|' || r FROM raw WHERE (least(l, r), greatest(l, r)) IN (SELECT (x, y) FROM twice)
  UNION ALL SELECT 'EDGE_DANGLING', l || '|' || r FROM dangling WHERE (least(l, r), greatest(l, r)) NOT IN (SELECT (x, y) FROM twice) UNION ALL SELECT 'EDGE_CONFLICT', 'k:' || c FROM bad1 UNION ALL SELECT 'AMBIGUOUS', name FROM at2 GROUP BY name HAVING count(DISTINCT school) > 1 AND count(DISTINCT c) > 1""")
def dia_01_identity_codes(spark: SparkSession, sf: str) -> DataFrame:
    return identity.resolve(people(spark, sf), _key_links(spark, sf))[1]


_FLAGS = "[[1, 1, 1], [0, 1, 1], [0, 0, 1], [0, 0, 0]]"


@query(f"""WITH c AS (SELECT c_custkey AS k, [[[1, 1, 1], [0, 0, 1]], list_slice({_FLAGS}, 1, CAST(c_custkey % 4 + 1 AS BIGINT)), list_slice({_FLAGS}, CAST(c_custkey % 3 + 1 AS BIGINT), 4)] AS slots, [c_custkey % 2 + c_custkey % 5 // 3, 1 + c_custkey % 7 // 4, 2 + c_custkey % 11 // 8] AS totals FROM customer),
  w AS (SELECT k, i, j, l, slots[1][i + 1] AS a, slots[2][j + 1] AS b, slots[3][l + 1] AS d, totals FROM c, range(4) x(i), range(4) y(j), range(4) z(l) WHERE i < len(slots[1]) AND j < len(slots[2]) AND l < len(slots[3])),
  f AS (SELECT k, count(*) AS n, min(i || ',' || j || ',' || l) AS chosen FROM w WHERE a[1] + b[1] + d[1] = totals[1] AND a[2] + b[2] + d[2] = totals[2] AND a[3] + b[3] + d[3] = totals[3] GROUP BY 1)
  SELECT c.k AS c_custkey, CASE WHEN n = 1 THEN chosen END AS chosen, CASE WHEN n IS NULL THEN 'NO_COMBINATION' WHEN n > 1 THEN 'AMBIGUOUS' END AS code FROM c LEFT JOIN f USING (k)""")
def grf_10_unique_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Three slots of win, top-three and final flags a customer, and totals that none, one or several combinations reach."""
    k = F.col("c_custkey")
    vectors = [[1, 1, 1], [0, 1, 1], [0, 0, 1], [0, 0, 0]]
    flags = lambda vs: F.array(*[F.array(*[F.lit(x) for x in v]) for v in vs])
    slots = F.array(flags([vectors[0], vectors[2]]), F.slice(flags(vectors), F.lit(1), (k % 4 + 1).cast("int")), F.slice(flags(vectors), (k % 3 + 1).cast("int"), F.lit(4)))
    part = lambda m, d: F.floor(k % m / d).cast("int")
    totals = F.array((k % 2).cast("int") + part(5, 3), 1 + part(7, 4), 2 + part(11, 8))
    found = choices.unique_choices(table(spark, sf, "customer").select("c_custkey", slots.alias("slots"), totals.alias("totals")), "c_custkey", "slots", "totals")
    return found.select("c_custkey", F.array_join("chosen", ",").alias("chosen"), "code")


# Matching and joins ----------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT id AS lineage_id, min(canonical_name) AS name, min(tier) AS tier FROM lineages GROUP BY 1),
  c AS (SELECT e.id AS candidate_id, l.name AS title, CAST(TRY_CAST(e.start_at AS TIMESTAMPTZ) AS TIMESTAMP) AS s, CAST(TRY_CAST(e.end_at AS TIMESTAMPTZ) AS TIMESTAMP) AS t, e.tier, e.id LIKE '%3' AS overlap, e.id LIKE '%4' AS middle, CASE WHEN e.id LIKE '%5' THEN 'somebody' ELSE 'host ' || l.tier END AS organizer, CASE WHEN e.id LIKE '%6' THEN 'none' ELSE 'ix' END AS label, CASE WHEN e.id LIKE '%8' THEN 'key-' || e.lineage_id END AS pk
    FROM (SELECT DISTINCT id, lineage_id, tier, start_at, end_at FROM editions) e JOIN f l USING (lineage_id)),
  p AS (SELECT candidate_id, lineage_id, 0 AS rule FROM c JOIN f ON pk = 'key-' || lineage_id UNION SELECT candidate_id, lineage_id, 2 FROM c JOIN f ON lower(trim(regexp_replace(regexp_replace(title, '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(regexp_replace(name, '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g')))),
  w AS (SELECT p.*, c.*, f.tier AS ft, CASE WHEN month(s) >= 8 THEN year(s) ELSE year(s) - 1 END AS y FROM p JOIN c USING (candidate_id) JOIN f USING (lineage_id)),
  j AS (SELECT candidate_id, lineage_id, rule, CASE WHEN organizer <> 'host ' || ft THEN 'ORGANIZER_CONTRADICTION' WHEN overlap THEN 'INDEPENDENT_OVERLAP' WHEN middle THEN 'MIDDLE_SCHOOL_ONLY' WHEN s IS NULL OR t IS NULL OR t < s THEN 'MALFORMED_CANDIDATE'
    WHEN s < make_timestamp(y, 9, 1, 0, 0, 0.0) OR t > make_timestamp(y + 1, 4, 1, 0, 0, 0.0) - INTERVAL 1 MILLISECOND THEN 'OUTSIDE_LINEAGE_WINDOW' WHEN label = 'none' THEN 'NO_ELIGIBLE_EVENT' END AS why FROM w),
  b AS (SELECT * FROM j WHERE why IS NULL QUALIFY rule = min(rule) OVER (PARTITION BY lineage_id))
  SELECT lineage_id, CASE WHEN count(*) = 1 THEN min(candidate_id) END AS candidate_id, CASE rule WHEN 0 THEN 'verified-platform-key' ELSE 'exact-facts' END AS basis, count(*) > 1 AS ambiguous, NULL AS reason FROM b GROUP BY lineage_id, rule
  UNION ALL SELECT DISTINCT lineage_id, candidate_id, NULL, NULL, why FROM j WHERE why IS NOT NULL""")
def jon_29_flt_15_precedence_match(spark: SparkSession, sf: str) -> DataFrame:
    """Editions as candidates for lineages: platform key before exact facts; every hard rule is broken by some."""
    f = table(spark, sf, "lineages").groupBy(F.col("id").alias("lineage_id")).agg(F.min("canonical_name").alias("name"), F.min("tier").alias("tier"))
    host = F.concat(F.lit("host "), "tier")
    e = distinct(spark, sf, "editions", "id", "lineage_id", "start_at", "end_at").join(f, "lineage_id")
    at = lambda c: time.instant(F.col(c)).cast("timestamp_ntz").alias(c)
    ends = lambda d: F.col("id").endswith(d)
    candidates = e.select(F.col("id").alias("candidate_id"), F.upper("name").alias("title"), at("start_at"), at("end_at"), F.when(ends("5"), "somebody").otherwise(host).alias("organizer"), F.when(ends("6"), F.array(F.lit("none"))).otherwise(F.array(F.lit("IX"))).alias("event_labels"),
                          F.when(ends("8"), F.concat(F.lit("key-"), "lineage_id")).alias("platform_key"), F.lit(None).cast("string").alias("past_key"), ends("4").alias("middle_school_only"), ends("3").alias("independent_overlap"))
    prints = f.select("lineage_id", F.array("name").alias("names"), F.array(host).alias("organizers"), F.array(F.lit("ix")).alias("labels"), F.array(F.concat(F.lit("key-"), "lineage_id")).alias("platform_keys"), F.array().cast("array<string>").alias("past_keys"), F.lit(9).alias("start_month"), F.lit(3).alias("end_month"))
    matches, rejected = matching.match_lineages(candidates, prints)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return matches.select("lineage_id", "candidate_id", "basis", "ambiguous", none("string", "reason")).unionByName(rejected.select("lineage_id", "candidate_id", none("string", "basis"), none("boolean", "ambiguous"), "reason"))


_CORE = ["edition_id", "competitor_id", "snapshot_id", "division", "lineage_id", "placement", "furthest_stage", "won_final_round", "points", "rule_id"]


@query(f"""SELECT {', '.join(_CORE)}, arg_max(id, (ingested_at, id)) AS id, arg_max(display_name, (ingested_at, id)) AS display_name FROM awards WHERE points > 0 GROUP BY ALL""")
def jon_12_widened(spark: SparkSession, sf: str) -> DataFrame:
    """Selected awards get back their other columns by ten core columns; of awards alike in these the last stands."""
    a = table(spark, sf, "awards").where("points > 0").select(*_CORE, "id", "display_name", "ingested_at")
    return checks.latest(a, _CORE, ["ingested_at", "id"]).select(*_CORE, "id", "display_name")


@query("""SELECT s.event_id, d.code, count(*) AS rows FROM (SELECT id, result_set_id, CASE WHEN published_school IS NULL THEN 'SCHOOL_MISSING' ELSE 'LOW_PLACE' END AS code FROM (SELECT DISTINCT id, result_set_id, placement, published_school FROM results) WHERE published_school IS NULL OR placement > 20) d
  JOIN (SELECT DISTINCT id, event_id FROM result_sets) s ON s.id = d.result_set_id GROUP BY 1, 2""")
def jon_24_diagnostics_by_event(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "results", "id", "result_set_id", "placement", "published_school")
    rules = [("SCHOOL_MISSING", F.col("published_school").isNotNull()), ("LOW_PLACE", F.coalesce(F.col("placement") <= 20, F.lit(True)))]
    bad = checks.validate(r, rules)[1].select("result_set_id", F.col("error_code").alias("code"))
    return bad.join(distinct(spark, sf, "result_sets", F.col("id").alias("result_set_id"), "event_id"), "result_set_id").groupBy("event_id", "code").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT edition_id, lineage_id, event_id, event_division, count(DISTINCT id) AS sets, count(DISTINCT snapshot_id) AS snapshots FROM result_sets GROUP BY 1, 2, 3, 4")
def agg_02_decision_groups(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["edition_id", "lineage_id", "event_id", "event_division"]
    return table(spark, sf, "result_sets").groupBy(*keys).agg(F.count_distinct("id").alias("sets"), F.count_distinct("snapshot_id").alias("snapshots"))


@query("SELECT source_person_key, published_school FROM (SELECT source_person_key, published_school, row_number() OVER (PARTITION BY source_person_key ORDER BY count(*) DESC, published_school) AS r FROM results WHERE published_school IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def agg_11_modal_school(spark: SparkSession, sf: str) -> DataFrame:
    return views.modal_school(table(spark, sf, "results"), "source_person_key", "published_school")


_ENCODED = "replace(replace(replace(replace(replace(url_encode({c}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"""WITH a AS (SELECT {identity_sql('matched_alias')} AS key, min(canonical_school_id) AS school_id FROM competitors WHERE matched_alias IS NOT NULL AND canonical_school_id NOT LIKE 'unknown%' GROUP BY 1),
  c AS (SELECT competitor_id, display_school, {identity_sql('display_school')} AS key FROM (SELECT DISTINCT competitor_id, display_school FROM competitors))
  SELECT competitor_id, display_school, coalesce(school_id, 'unknown-school:' || {_ENCODED.format(c='c.key')}) AS school_id FROM c LEFT JOIN a USING (key)""")
def jon_13_alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Schools by their normalized name in the registry of aliases, others by an id made of that name."""
    registry = table(spark, sf, "competitors").where("matched_alias IS NOT NULL AND canonical_school_id NOT LIKE 'unknown%'").groupBy(text.identity_text(F.col("matched_alias")).alias("key")).agg(F.min("canonical_school_id").alias("school_id"))
    c = distinct(spark, sf, "competitors", "competitor_id", "display_school").withColumn("key", text.identity_text(F.col("display_school")))
    return c.join(registry, "key", "left").select("competitor_id", "display_school", F.coalesce("school_id", text.unknown_school_id(F.col("display_school"))).alias("school_id"))


@query(f"""WITH c AS (SELECT {identity_sql('display_name')} AS key, min(competitor_id) AS c, min(display_name) AS shown FROM (SELECT DISTINCT competitor_id, display_name FROM competitors WHERE display_name IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT competitor_id) = 1),
  r AS (SELECT id, published_name, {identity_sql('published_name')} AS key FROM (SELECT DISTINCT id, published_name FROM results))
  SELECT id, CASE WHEN c.c IS NULL THEN 'NO_SINGLE_MATCH' WHEN published_name IS DISTINCT FROM shown THEN 'NAME_DIFFERS' END AS error, CASE WHEN published_name = shown THEN c.c END AS competitor_id FROM r LEFT JOIN c ON c.key = r.key""")
def jon_31_submitted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that mean exactly one competitor by their normalized form, and are written as it is."""
    c = distinct(spark, sf, "competitors", "competitor_id", "display_name").where("display_name IS NOT NULL").withColumn("key", text.identity_text(F.col("display_name")))
    one = c.groupBy("key").agg(F.min("competitor_id").alias("_c"), F.max("competitor_id").alias("_d"), F.min("display_name").alias("shown")).where("_c = _d AND key IS NOT NULL")
    r = distinct(spark, sf, "results", "id", "published_name").withColumn("key", text.identity_text(F.col("published_name"))).join(one, "key", "left")
    same = F.col("published_name").eqNullSafe(F.col("shown"))
    return r.select("id", F.when(F.col("_c").isNull(), "NO_SINGLE_MATCH").when(~same, "NAME_DIFFERS").alias("error"), F.when(F.col("_c").isNotNull() & same, F.col("_c")).alias("competitor_id"))


# Orders ----------------------------------------------------------------------------------------------------------------


@query("SELECT id, row_number() OVER (ORDER BY edition_id NULLS FIRST, source_entry_id NULLS FIRST, id NULLS FIRST) AS evidence_id FROM (SELECT DISTINCT id, edition_id, source_entry_id FROM results)")
def win_06_evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = distinct(spark, sf, "results", "id", "edition_id", "source_entry_id")
    return identity.evidence_ids(r, ["edition_id", "source_entry_id", "id"]).select("id", F.col("evidence_id").cast("bigint").alias("evidence_id"))


@query("SELECT result_set_id, md5(string_agg(j, ',' ORDER BY j)) AS digest FROM (SELECT DISTINCT result_set_id, '[\"' || source_entry_id || '\",' || coalesce(CAST(placement AS VARCHAR), 'null') || ',' || coalesce('\"' || furthest_stage || '\"', 'null') || ']' AS j FROM results WHERE source_entry_id IS NOT NULL) GROUP BY 1")
def srt_05_canonical_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every set's rows in canonical order, whatever order they come in (one published set is one list)."""
    j = canon.json_tuple_key(F.col("source_entry_id"), F.col("placement").cast("string"), F.col("furthest_stage"))
    plain = F.regexp_replace(j, r'^(\["[^"]*",)"(-?\d+)"', "$1$2")
    r = table(spark, sf, "results").where("source_entry_id IS NOT NULL").select("result_set_id", plain.alias("j")).distinct()
    return r.groupBy("result_set_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("j")), ",")).alias("digest"))


@query("""SELECT e.season_id, e.id, row_number() OVER (PARTITION BY season_id ORDER BY l.tier NULLS LAST, e.lineage_id NULLS LAST, e.id) AS place FROM (SELECT DISTINCT id, season_id, lineage_id FROM editions) e LEFT JOIN (SELECT id, min(tier) AS tier FROM lineages GROUP BY 1) l ON l.id = e.lineage_id""")
def srt_07_tournaments(spark: SparkSession, sf: str) -> DataFrame:
    """A season has at most a few editions of each lineage, so its order is a window."""
    l = table(spark, sf, "lineages").groupBy(F.col("id").alias("lineage_id")).agg(F.min("tier").alias("tier"))  # noqa: E741
    w = Window.partitionBy("season_id").orderBy(F.asc_nulls_last("tier"), F.asc_nulls_last("lineage_id"), "id")
    return distinct(spark, sf, "editions", "id", "season_id", "lineage_id").join(l, "lineage_id", "left").select("season_id", "id", F.row_number().over(w).cast("bigint").alias("place"))


# Filters on texts --------------------------------------------------------------------------------------------------------

_EVENTS = ["International Extemp (Online)", "b USX varsity", "JV Extemp", "Novice IX", "Open Extemp", "US  EXTEMP", "Lincoln Douglas", "Junior-Varsity Extemp", "ix", "Extemp varsity varsity"]
_EVENT_KEYS = ["extemp", "international extemp", "ix", "open extemp", "us extemp", "usx"]


@query("""SELECT o_orderkey, list_extract([true, true, false, false, true, true, false, false, true, false], CAST(o_orderkey % 10 AS INT) + 1) AS eligible FROM orders""")
def flt_05_listed_events(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(e) for e in _EVENTS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.listed_event(name, _EVENT_KEYS).alias("eligible"))


@query("""SELECT o_orderkey, o_orderkey % 6 IN (0, 5) AS allowed FROM orders""")
def flt_07_allowed_sources(spark: SparkSession, sf: str) -> DataFrame:
    urls = ["https://tab.example/r?x=", "http://tab.example/", "https://tab.example:443/", "https://me@tab.example/", "https://tab.example.org/", "HTTPS://TAB.example/"]
    u = F.concat(F.element_at(F.array(*[F.lit(x) for x in urls]), (F.col("o_orderkey") % 6 + 1).cast("int")), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", url.allowed_source(u, F.array(F.lit("tab.example"))).alias("allowed"))


@query("SELECT c_custkey, c_custkey % 4 = 1 AS placeholder FROM customer")
def flt_19_placeholder_school(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    name = F.when(n % 4 == 1, F.concat(F.lit("School not in export "), n)).when(n % 4 == 2, F.concat(F.lit("School not in export "), n, F.lit("b"))).when(n % 4 == 3, F.concat(F.lit("The School not in export "), n)).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.placeholder_school(F.when(n % 8 != 4, name), "School not in export").alias("placeholder"))


@query("SELECT o_orderkey, list_extract([true, false, false, false, false, false, true, false], CAST(o_orderkey % 8 AS INT) + 1) AS safe FROM orders")
def flt_20_safe_path(spark: SparkSession, sf: str) -> DataFrame:
    paths = ["a/b/c.json", "/etc/x", "a/../b", "a//b", "C:/x", "a\\b", "..a/.b", "./a"]
    p = F.element_at(F.array(*[F.lit(x) for x in paths]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.safe_relative_path(p).alias("safe"))


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'WRONG_TOURNAMENT' WHEN 2 THEN 'WRONG_SEASON' WHEN 3 THEN 'PLACEMENTS_MISMATCH' WHEN 4 THEN 'PLACEMENTS_MISMATCH' WHEN 5 THEN 'PLACEMENTS_MISMATCH' END AS error FROM customer""")
def flt_21_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of three placements a customer: right ones, ones of another tournament or year, in another order, without places, or with places too far away."""
    k, name = F.col("c_custkey") % 7, F.col("c_name")
    names = F.array(F.concat(name, F.lit(" A")), F.concat(name, F.lit(" B")), F.concat(name, F.lit(" C")))
    line = lambda place, i: F.concat(F.lit(place), names[i])
    places = F.when(k == 3, F.concat_ws("\n", line("1. ", 1), line("2nd ", 0), line("3rd: ", 2))).when(k == 4, F.concat_ws("\n", line("1. ", 0), line("12 ", 1), line("3 ", 2)))
    places = places.when(k == 5, F.concat_ws("\n", line("1. ", 0), line("2nd, far away from the name, ", 1), line("3 ", 2))).otherwise(F.concat_ws("\n", line("1st - ", 0), line(" 2)  ", 1), line("3rd: ", 2)))
    body = F.concat(F.when(k == 1, "Some other open").otherwise("The  ROUND\u00a0Robin of 7"), F.lit(" in "), F.when(k == 2, "2024").otherwise("2025"), F.lit("\n"), places)
    sheets = table(spark, sf, "customer").select("c_custkey", "c_name", body.alias("sheet"))
    return text.with_evidence_error(sheets, "sheet", ["round robin"], F.lit("2025"), names).select("c_custkey", "error")


_LABELS = {"Quarters": "quarterfinal", "QF 2": "quarterfinal", "Octo-Finals": "octafinal", "Round of 16": "octafinal", "top 4": "semifinal", "Semis": "semifinal", "FINAL ROUND": "final", "Round 3": None, "": None, "Finals12": "final", "semi finalists": None}


@query(f"SELECT o_orderkey, list_extract({[v or '' for v in _LABELS.values()]}, CAST(o_orderkey % {len(_LABELS)} AS INT) + 1) AS stage FROM orders")
def str_05_round_stage(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("o_orderkey") % len(_LABELS) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(text.round_stage(label), F.lit("")).alias("stage"))


_TEXT_A, _TEXT_B = "repeat(c_name, 3 + CAST(c_custkey % 4 AS INT))", "substr(repeat(c_name, 3 + CAST(c_custkey % 4 AS INT)), 1 + CAST(c_custkey % 3 AS INT)) || repeat('x', CAST(c_custkey % 2 AS INT))"


@query(f"SELECT c_custkey, a = b OR (greatest(length(a), length(b)) >= 50 AND levenshtein(a, b) * 50 <= greatest(length(a), length(b))) AS alike FROM (SELECT c_custkey, {_TEXT_A} AS a, {_TEXT_B} AS b FROM customer)")
def str_14_similar_98(spark: SparkSession, sf: str) -> DataFrame:
    """Names written three to six times over, some without their first letters or with one more at the end."""
    d = table(spark, sf, "customer").select("c_custkey", F.expr(_TEXT_A).alias("a"), F.expr(_TEXT_B).alias("b"))
    return d.select("c_custkey", text.similar_98(F.col("a"), F.col("b")).alias("alike"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'NOT_UTF8' WHEN 2 THEN 'BOM' WHEN 3 THEN 'NOT_UTF8' END AS error FROM documents WHERE text IS NOT NULL")
def str_18_utf8(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as bytes: as they are, with a stray byte behind them, behind a mark of byte order, and cut within a character."""
    b, k = F.col("text").cast("binary"), F.col("doc_id") % 4
    stray, mark, cut = F.unhex(F.lit("FF")), F.unhex(F.lit("EFBBBF")), F.unhex(F.lit("C3"))
    made = F.when(k == 1, F.concat(b, stray)).when(k == 2, F.concat(mark, b)).when(k == 3, F.concat(b, cut)).otherwise(b)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.utf8_error(made).alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'DIGEST_MISMATCH' WHEN doc_id % 11 = 0 THEN 'SIZE_MISMATCH' END AS error FROM documents WHERE text IS NOT NULL")
def val_02_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against reviewed digests and sizes, some of which are wrong."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    want = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"), (F.octet_length("text") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("bigint").alias("bytes"))
    return checks.digest_errors(d.select("doc_id", "text"), want, "doc_id", "text")


# Updates and jobs ----------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT competitor_id, max(points) AS points FROM standing_rows GROUP BY 1), b AS (SELECT competitor_id, max(points) AS points FROM awards WHERE competitor_id IS NOT NULL GROUP BY 1)
  SELECT a.competitor_id, CASE WHEN b.points > a.points THEN b.points ELSE a.points END AS points, 'row' AS what FROM a LEFT JOIN b USING (competitor_id) UNION ALL SELECT b.competitor_id, NULL, 'unchanged' FROM b LEFT JOIN a USING (competitor_id) WHERE NOT coalesce(b.points > a.points, false)""")
def dml_03_guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    best = lambda t: table(spark, sf, t).where("competitor_id IS NOT NULL").groupBy("competitor_id").agg(F.max("points").alias("points"))
    updated, missed = stores.guarded_update(best("standing_rows"), best("awards"), ["competitor_id"], F.col("new.points") > F.col("old.points"))
    return updated.withColumn("what", F.lit("row")).unionByName(missed.select("competitor_id", F.lit(None).cast(dict(updated.dtypes)["points"]).alias("points"), F.lit("unchanged").alias("what")))


@query("""SELECT id, CAST(tier + 1 AS INT) AS tier, 'migrated' AS outcome FROM (SELECT DISTINCT id, tier FROM lineages) UNION ALL SELECT 'again', 0, 'not needed' UNION ALL SELECT 'in use', NULL, 'refused' UNION ALL SELECT 'other facts', NULL, 'refused'""")
def dml_05_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Every lineage moves one tier down; again, which changes nothing; with awards that depend on it; and with a name that differs."""
    facts = distinct(spark, sf, "lineages", "id", "tier", "canonical_name")
    target, none = facts.withColumn("tier", (F.col("tier") + 1).cast("int")), table(spark, sf, "awards").where("false")
    moved, _ = stores.migrate(facts, target, "id", ["canonical_name"], ["tier"], none)
    again = stores.migrate(moved, target, "id", ["canonical_name"], ["tier"], table(spark, sf, "awards"))[1]

    def outcome(expected: DataFrame, blockers: DataFrame) -> str:
        try:
            return str(stores.migrate(facts, expected, "id", ["canonical_name"], ["tier"], blockers)[1])
        except stores.MigrationRefused:
            return "refused"

    other = target.withColumn("canonical_name", F.upper("canonical_name"))
    notes = [("again", again, "not needed" if not again else "migrated"), ("in use", None, outcome(target, table(spark, sf, "awards"))), ("other facts", None, outcome(other, none))]
    return moved.select("id", F.col("tier").cast("int").alias("tier"), F.lit("migrated").alias("outcome")).unionAll(spark.createDataFrame(notes, "id string, tier int, outcome string"))


@query("SELECT DISTINCT id FROM snapshots WHERE id LIKE '%7' AND media_type IS NOT NULL")
def dml_07_ensure_or_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots inserted again, those with ids in 7 with another media type: only these are conflicts."""
    s = distinct(spark, sf, "snapshots", "id", "sha256", "media_type")
    again = s.withColumn("media_type", F.when(F.col("id").endswith("7"), F.concat("media_type", F.lit("+x"))).otherwise(F.col("media_type")))
    return stores.conflicting(s, again, ["id"])


@query("""SELECT sha256(CAST(user_id AS VARCHAR)) AS job_id, CASE WHEN user_id % 2 = 0 OR (user_id % 3 = 0 AND bool_or(event_id % 5 = 0)) THEN 'sent' ELSE 'pending' END AS state FROM events GROUP BY user_id""")
def stm_02_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of all users; even ones were sent before; of the others every third is tried now, and goes out if one attempt succeeds."""
    e = table(spark, sf, "events")
    job = F.sha2(F.col("user_id").cast("string"), 256).alias("job_id")
    before = e.where("user_id % 2 = 0").select(job, F.lit("sent").alias("state")).distinct()
    return stores.claim_outbox(before, e.select(job), e.where("user_id % 3 = 0").select(job, (F.col("event_id") % 5 == 0).alias("ok")))


@query("""WITH h AS (SELECT user_id AS name, 'a' AS owner, max(ts) AS held FROM events GROUP BY 1), c AS (SELECT user_id AS name, CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS owner, max(ts) + CASE user_id % 4 WHEN 0 THEN INTERVAL 0 SECOND WHEN 1 THEN INTERVAL 1 SECOND ELSE INTERVAL (-5) MINUTE END AS at FROM events GROUP BY user_id)
  SELECT h.name, CASE WHEN held < c.at OR h.owner = c.owner THEN c.owner ELSE h.owner END AS owner, CAST(CASE WHEN held < c.at OR h.owner = c.owner THEN c.at + INTERVAL 900 SECOND ELSE held END AS VARCHAR) AS until FROM h JOIN c USING (name) WHERE NOT (h.name % 5 = 0 AND NOT (held < c.at) AND h.owner <> c.owner)""")
def stm_05_dml_02_leases(spark: SparkSession, sf: str) -> DataFrame:
    """Leases of all users against claims before, at and behind their expiry, some of the owner; then the first owner gives back every fifth."""
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("at"))
    n = F.col("name") % 4
    shift = F.when(n == 0, F.lit(0)).when(n == 1, F.lit(1)).otherwise(F.lit(-300))
    claims = last.select("name", F.when(F.col("name") % 3 == 0, "a").otherwise("b").alias("owner"), (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift)).alias("at"))
    taken = store(stores.take_leases(last.withColumn("owner", F.lit("a")).select("name", "owner", "at"), claims), "leases").df
    kept_by_a = last.where("name % 5 = 0").join(claims.select("name", F.col("owner").alias("_o")), "name").where("_o <> 'a'").select("name", F.lit("a").alias("owner"))
    return stores.release_leases(taken, kept_by_a).select("name", "owner", F.col("at").cast("string").alias("until"))


_EDITIONS = """ed AS (SELECT e.id, e.season_id, e.lineage_id, e.status, CAST(TRY_CAST(e.start_at AS TIMESTAMPTZ) AS TIMESTAMP) AS s, CAST(TRY_CAST(e.end_at AS TIMESTAMPTZ) AS TIMESTAMP) AS t, max(CAST(TRY_CAST(x.retrieved_at AS TIMESTAMPTZ) AS TIMESTAMP)) AS latest, count(DISTINCT x.id) AS evidence, e.season_id < '2016-17' AS fin
  FROM (SELECT DISTINCT id, season_id, lineage_id, status, start_at, end_at FROM editions) e LEFT JOIN snapshots x ON x.edition_id = e.id GROUP BY ALL)"""
_NOW = "2019-03-06 10:00:00"


def _editions(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c: time.instant(F.col(c)).cast("timestamp_ntz")
    latest = table(spark, sf, "snapshots").groupBy(F.col("edition_id").alias("id")).agg(F.max(at("retrieved_at")).alias("latest"))
    return distinct(spark, sf, "editions", "id", "season_id", "lineage_id", "status", at("start_at").alias("start_at"), at("end_at").alias("end_at")).join(latest, "id", "left").withColumn("final_season", F.col("season_id") < "2016-17")


@query(f"WITH {_EDITIONS} SELECT id, evidence, coalesce(t IS NOT NULL AND greatest(t, latest) + INTERVAL 7 DAY <= TIMESTAMP '{_NOW}', false) AS stable FROM ed")
def stm_06_stability(spark: SparkSession, sf: str) -> DataFrame:
    shots = distinct(spark, sf, "snapshots", "id", "edition_id", time.instant(F.col("retrieved_at")).cast("timestamp_ntz").alias("at")).select(F.col("edition_id").alias("id"), "at")
    return jobs.stability(shots, _editions(spark, sf).select("id", "end_at"), "id", "at", "end_at", _NOW)


@query(f"""WITH {_EDITIONS}, d AS (SELECT *, NOT fin AND TIMESTAMP '{_NOW}' < greatest(t, latest) + INTERVAL 7 DAY AS waiting FROM ed WHERE s IS NOT NULL AND t <= TIMESTAMP '{_NOW}')
  SELECT id, 'collect-results' AS kind, 'RESULTS_ENDED' AS reason, t AS scheduled_for FROM d WHERE NOT fin UNION ALL SELECT id, 'verify-stability', CASE WHEN fin THEN 'FINAL_SEASON_WEEKLY_CORRECTION' WHEN waiting THEN 'STABILITY_DAILY' ELSE 'STABILITY_WEEKLY' END,
  CASE WHEN waiting THEN TIMESTAMP '2019-03-06 08:17:00' ELSE TIMESTAMP '2019-03-04 08:17:00' END FROM d""")
def stm_09_scheduled_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.scheduled_jobs(_editions(spark, sf), _NOW)


@query(f"""WITH {_EDITIONS}, c AS (SELECT max(lineage_id) AS l FROM editions WHERE status IN ('final', 'corrected') AND season_id >= '2016-17') SELECT season_id, min(greatest(t, latest) + INTERVAL 7 DAY) AS stable_at FROM ed WHERE lineage_id = (SELECT l FROM c) AND status IN ('final', 'corrected') AND NOT fin AND greatest(t, latest) + INTERVAL 7 DAY <= TIMESTAMP '2030-01-01' GROUP BY 1""")
def stm_11_ready_seasons(spark: SparkSession, sf: str) -> DataFrame:
    closing = table(spark, sf, "editions").where("status IN ('final', 'corrected') AND season_id >= '2016-17'").agg(F.max("lineage_id")).first()[0]
    return jobs.ready_seasons(_editions(spark, sf), "2030-01-01 00:00:00", closing)


@query("SELECT edition_id, sha256, count(*) AS arrivals FROM (SELECT DISTINCT edition_id, sha256 FROM snapshots) GROUP BY 1, 2")
def stm_10_new_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots as a stream, a file a micro-batch: a content that an edition has brought already ends there."""
    s = jobs.read_stream(spark, sf, "snapshots", 1).select("edition_id", "sha256", "id")
    return jobs.run_to_end(jobs.new_evidence(s)).groupBy("edition_id", "sha256").agg(F.count(F.lit(1)).alias("arrivals"))


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 5 = 0 AS ok FROM events) SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(4 AS INT) AS attempts, 'ATTEMPTS_EXHAUSTED' AS code FROM t WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4 AND NOT bool_or(ok)""")
def stm_12_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.read_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("ok"))
    return jobs.dead_letters(jobs.run_to_end(jobs.retry_states(e)))


_JOB_EVENTS = ["enqueued", "started", "failed", "started", "started", "failed", "succeeded", "started", "refused", "failed", "started", "succeeded", "started"]


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS BIGINT) AS seq, CASE WHEN row_number() OVER w = 1 THEN 'enqueued' ELSE list_extract({_JOB_EVENTS}, CAST(event_id % 13 + 1 AS INT)) END AS event, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  r AS (SELECT job_id, n, seq, 'queued' AS state, 0 AS attempts, true AS changed FROM e WHERE n = 1
    UNION ALL SELECT e.job_id, e.n, e.seq, CASE WHEN event = 'started' AND state IN ('queued', 'retrying') THEN 'running' WHEN state = 'running' AND event = 'succeeded' THEN 'succeeded' WHEN state = 'running' AND event = 'refused' THEN 'failed' WHEN state = 'running' AND event = 'failed' THEN CASE WHEN attempts >= 4 THEN 'dead_lettered' ELSE 'retrying' END ELSE state END,
      attempts + CASE WHEN event = 'started' AND state IN ('queued', 'retrying') THEN 1 ELSE 0 END, (event = 'started' AND state IN ('queued', 'retrying')) OR (state = 'running' AND event IN ('succeeded', 'refused', 'failed')) FROM r JOIN e ON e.job_id = r.job_id AND e.n = r.n + 1)
  SELECT job_id, seq, state, CAST(attempts AS INT) AS attempts, CAST(CASE WHEN state = 'retrying' THEN CASE attempts WHEN 1 THEN 900 WHEN 2 THEN 3600 ELSE 21600 END END AS INT) AS wait_seconds FROM r WHERE changed""")
def stm_03_job_states(spark: SparkSession, sf: str) -> DataFrame:
    """A job a user: enqueued by its first event, then whatever comes, fitting or not."""
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("_first"))
    e = jobs.read_stream(spark, sf, "events").join(first, "user_id")
    event = F.when(F.col("event_id") == F.col("_first"), "enqueued").otherwise(F.element_at(F.array(*[F.lit(x) for x in _JOB_EVENTS]), (F.col("event_id") % 13 + 1).cast("int")))
    return jobs.run_to_end(jobs.job_states(e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("bigint").alias("seq"), event.alias("event"))))
