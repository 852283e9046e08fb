"""Sources, sinks and stores run end to end over whole tables: exports, pages, files and versions are written from the tables, read by the operators, and compared by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, text
from ..operators import store as stores
from ..operators import views
from ..runtime import scratch_root, store, table
from ..sources import archives, calendar, documents, pdf_rows, provider

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# Provider exports: one document an event ---------------------------------------------------------------------------

_DEPTH = "CASE furthest_stage WHEN 'octafinal' THEN 1 WHEN 'quarterfinal' THEN 2 WHEN 'semifinal' THEN 3 WHEN 'final' THEN 4 END"
_STAGE = "CASE {d} WHEN 1 THEN 'octafinal' WHEN 2 THEN 'quarterfinal' WHEN 3 THEN 'semifinal' WHEN 4 THEN 'final' END"
_KEYED = "edition_id IS NOT NULL AND event_key IS NOT NULL AND source_entry_id IS NOT NULL AND result_set_id IS NOT NULL"


def _export(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose id ends in 7 are missing from the schools, entries without a person key have no student."""
    r = table(spark, sf, "results").where(_KEYED).select(F.concat_ws(":", "edition_id", "event_key").alias("event"), F.col("event_key").alias("event_name"), "result_set_id", "source_entry_id", "placement", F.expr(_DEPTH).alias("d"), "published_name", F.coalesce("published_school", F.lit("")).alias("school"), "source_person_key")
    r = r.withColumn("entry", F.concat_ws("/", "event", "source_entry_id"))
    rows = r.groupBy("event", "event_name", "result_set_id", "entry").agg(F.min("placement").alias("placement"), F.max("d").alias("d"))
    rows = store(rows.withColumn("stage", F.expr(_STAGE.format(d="d"))), "export-rows").df
    round_id = F.concat_ws("/", "event", "stage")
    result = F.struct("entry", F.coalesce(F.col("placement").cast("string"), F.lit("prelim")).alias("place"), F.when(F.col("stage").isNotNull(), round_id).alias("round"))
    sets = rows.groupBy("event", "event_name", "result_set_id").agg(F.sort_array(F.collect_list(result)).alias("results"))
    one_set = F.struct("result_set_id", F.lit("Places").alias("label"), F.lit("final").alias("tag"), F.lit("0").alias("bracket"), F.lit("true").alias("published"), "results")
    sets = sets.groupBy("event", "event_name").agg(F.sort_array(F.collect_list(one_set)).alias("result_sets"))
    ranks = F.when(F.col("placement").isNotNull(), F.array(F.struct(F.lit(" Rank").alias("tag"), F.col("placement").cast("bigint").alias("value"))))
    sections = rows.where("stage IS NOT NULL").groupBy("event", "stage", "result_set_id").agg(F.collect_list(F.struct("entry", ranks.alias("scores"))).alias("ballots"))
    one_section = F.struct(F.col("result_set_id").alias("id"), F.col("result_set_id").alias("round"), "ballots")
    rounds = sections.groupBy("event", "stage").agg(F.collect_list(one_section).alias("sections"))
    kind = F.when(F.col("stage") == "final", "Final").otherwise("elim")
    rounds = rounds.groupBy("event").agg(F.collect_list(F.struct(round_id.alias("id"), F.initcap("stage").alias("label"), kind.alias("type"), "sections")).alias("rounds"))
    entries = r.where("source_entry_id NOT LIKE '%7'").groupBy("event", "entry").agg(F.min("published_name").alias("name"), F.min("school").alias("school"), F.min("source_person_key").alias("person"))
    one_entry = F.struct(F.col("entry").alias("id"), "event", F.array_compact(F.array("person")).alias("students"), "name")
    student = F.struct(F.col("person").alias("id"), F.lit("A").alias("first"), F.lit("B").alias("last"))
    schools = entries.groupBy("event", "school").agg(F.collect_list(one_entry).alias("entries"), F.collect_set(F.when(F.col("person").isNotNull(), student)).alias("students"))
    schools = schools.groupBy("event").agg(F.collect_list(F.struct(F.col("school").alias("id"), F.col("school").alias("name"), "entries", "students")).alias("schools"))
    whole = sets.join(rounds, "event", "left").join(schools, "event", "left")
    event = F.struct(F.col("event").alias("id"), F.col("event_name").alias("name"), "rounds", "result_sets")
    body = F.to_json(F.struct(F.lit(1).alias("id"), F.array(F.struct(F.lit("c").alias("id"), F.array(event).alias("events"))).alias("categories"), "schools"))
    return provider.parse_exports(whole.select(body.alias("body")), "body")


_EXPORT_SQL = f"""WITH r AS (SELECT edition_id || ':' || event_key AS event_id, event_key, result_set_id, edition_id || ':' || event_key || '/' || source_entry_id AS entry_id, placement, {_DEPTH} AS d, published_name, coalesce(published_school, '') AS school, source_person_key FROM results WHERE {_KEYED}),
  e AS (SELECT event_id, event_key, entry_id, min(published_name) AS name, min(school) AS school, min(source_person_key) AS person, max(d) AS deepest FROM r GROUP BY 1, 2, 3),
  s AS (SELECT event_id, result_set_id, entry_id, min(placement) AS placement, max(d) AS d FROM r GROUP BY 1, 2, 3),
  big AS (SELECT event_id, max(n) AS largest FROM (SELECT event_id, d, count(DISTINCT entry_id) AS n FROM s WHERE d IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  u AS (SELECT event_id, entry_id, max(d) AS deepest FROM s GROUP BY 1, 2),
  n AS (SELECT event_id, result_set_id, row_number() OVER (PARTITION BY event_id ORDER BY result_set_id) - 1 AS set_no FROM (SELECT DISTINCT event_id, result_set_id FROM s)),
  j AS (SELECT s.*, CAST(n.set_no AS INT) AS set_no, coalesce(s.d, u.deepest) AS stage, e.person, CASE WHEN s.entry_id LIKE '%7' THEN 'MISSING_ENTRY' WHEN e.person IS NULL THEN 'MISSING_PERSON' WHEN coalesce(s.d, u.deepest) IS NULL THEN 'UNKNOWN_ROUND_LABEL' END AS code
    FROM s JOIN n USING (event_id, result_set_id) JOIN u USING (event_id, entry_id) JOIN e USING (event_id, entry_id) LEFT JOIN big USING (event_id)
    WHERE placement IS NOT NULL AND NOT (coalesce(placement > largest, false) AND coalesce(s.d, u.deepest) IS NULL))"""


def _normalized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    export = store(_export(spark, sf), "exports").df
    rules = provider.events(export).select("category_id", "event_id", F.lit("lineage").alias("lineage_id"), F.lit("ix").alias("division"), F.array(F.lit("Places")).alias("labels"))
    return provider.normalize(export, store(rules, "export-rules").df)


@query(_EXPORT_SQL + f""" SELECT event_id, set_no, 'provider:entry:' || entry_id AS source_entry_id, 'provider:person:' || person AS source_person_key, placement, {_STAGE.format(d='stage')} AS furthest_stage, placement = 1 AND stage = 4 AS won_final_round FROM j WHERE code IS NULL""")
def prj_02_jon_01_jon_02_flt_04_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf)[0].select("event_id", "set_no", "source_entry_id", "source_person_key", "placement", "furthest_stage", "won_final_round")


@query(_EXPORT_SQL + """ SELECT event_id, set_no, entry_id, code FROM j WHERE code IS NOT NULL
  UNION ALL SELECT event_id, set_no, min(entry_id), 'DUPLICATE_PLACEMENT' FROM j WHERE code IS NULL GROUP BY event_id, set_no, placement HAVING count(*) > 1""")
def dia_01_provider_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf)[1].select("event_id", "set_no", "entry_id", "code")


@query(_EXPORT_SQL + " SELECT entry_id, event_id, person AS person_id, name, school FROM e WHERE entry_id NOT LIKE '%7' AND length(event_key) % 2 = 0")
def src_02_compact(spark: SparkSession, sf: str) -> DataFrame:
    return provider.compact(_export(spark, sf), F.length("event_name") % 2 == 0)


@query(_EXPORT_SQL + """, t AS (SELECT event_id, entry_id, CAST(sum(placement) AS BIGINT) AS total, count(*) AS ballots FROM s WHERE d = 4 AND placement IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT event_id, min(total) AS total, min(ballots) <> max(ballots) AS uneven FROM t GROUP BY 1), f AS (SELECT event_id, total, min(entry_id) AS entry_id, count(*) AS n FROM t JOIN b USING (event_id, total) GROUP BY 1, 2)
  SELECT event_id, entry_id, total, NULL AS code FROM f JOIN b USING (event_id, total) WHERE n = 1 AND NOT uneven UNION ALL SELECT event_id, NULL, NULL, 'UNEQUAL_BALLOTS' FROM b WHERE uneven UNION ALL SELECT event_id, NULL, NULL, 'TIED_FINAL' FROM f WHERE n > 1""")
def agg_07_final_winner(spark: SparkSession, sf: str) -> DataFrame:
    winners, errors = provider.final_winners(store(_export(spark, sf), "exports").df)
    none = F.lit(None)
    return winners.select("event_id", "entry_id", "total", none.cast("string").alias("code")).unionByName(errors.select("event_id", none.cast("string").alias("entry_id"), none.cast("bigint").alias("total"), "code"))


# Pages and documents -----------------------------------------------------------------------------------------------


@query("""SELECT id, canonical_name AS title, CASE WHEN n <> 2 THEN id || ' & co' END AS data_tournament, CASE WHEN n = 2 THEN 'DUPLICATE_ATTRIBUTE' WHEN n = 3 THEN 'UNSAFE_ATTRIBUTE' END AS error
  FROM (SELECT id, min(canonical_name) AS canonical_name, length(id) % 3 + 1 + CASE WHEN id LIKE '%3' THEN 1 ELSE 0 END AS n FROM lineages GROUP BY 1)""".replace("CASE WHEN n <> 2 THEN id || ' & co' END", "CASE WHEN n = 1 THEN id || ' & co' WHEN n <> 2 THEN id || ' > co' END").replace("WHEN n = 3 THEN", "WHEN n > 2 THEN"))
def src_08_details(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineages").groupBy("id").agg(F.min("canonical_name").alias("title")).withColumn("n", F.length("id") % 3 + 1 + F.when(F.col("id").like("%3"), 1).otherwise(0))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    first = F.concat(F.lit('<div data-tournament="'), safe("id"), F.when(F.col("n") == 1, " &amp; co").otherwise(" &gt; co"), F.lit('">'))
    second = F.when(F.col("n") == 2, "<p DATA-TOURNAMENT='x'></p>").otherwise("")
    page = F.concat(F.lit("<title>no</title>"), first, second, F.lit("<h1> <b>"), safe("title"), F.lit("</b> </h1></div><h1>no</h1>"))
    return calendar.details(d.select("id", page.alias("html")), "id", "html", ["data-tournament"])


@query("""SELECT policy_version_id AS id, CAST(row_number() OVER (PARTITION BY policy_version_id ORDER BY id) AS VARCHAR) AS tournament, canonical_name AS title FROM (SELECT policy_version_id, id, min(canonical_name) AS canonical_name FROM lineages GROUP BY 1, 2)
  QUALIFY canonical_name IN (SELECT l.canonical_name FROM lineages l JOIN editions e ON e.lineage_id = l.id WHERE e.tier = 2)""")
def flt_16_known_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A calendar of all lineages; only those that a tier-2 edition names are kept, by their titles in other spelling."""
    l = table(spark, sf, "lineages").groupBy("policy_version_id", "id").agg(F.min("canonical_name").alias("name"))  # noqa: E741
    n = F.row_number().over(Window.partitionBy("policy_version_id").orderBy("id"))
    link = F.concat(F.lit("<a href='/t?tourn_id="), n, F.lit("'>"), F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("</a>"))
    pages = l.withColumn("k", link).groupBy("policy_version_id").agg(F.concat_ws("", F.sort_array(F.collect_list("k"))).alias("html"))
    wanted = table(spark, sf, "editions").where("tier = 2").select(F.col("lineage_id").alias("id")).distinct().join(table(spark, sf, "lineages").select("id", "canonical_name").distinct(), "id")
    found = calendar.calendar_entries(pages, "policy_version_id", "html", "cal.example", titles=wanted.select(F.concat(F.lit(" "), F.upper("canonical_name"), F.lit("!")).alias("title")))
    return found.select("id", "tournament", "title")


@query("""WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS document, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)
  SELECT document, CAST(n AS INT) AS row_no, c_name || '|' || c_mktsegment AS cells, CASE WHEN c.document LIKE '%5' THEN 'AMBIGUOUS_TABLE' END AS error, n = m AS last_of_block FROM c""")
def win_08_table_block(spark: SparkSession, sf: str) -> DataFrame:
    """A title line, the header, the table, a foot line; in documents that end in 5 the header comes again behind it."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("document"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("row_no"), F.array("c_name", "c_mktsegment").alias("cells"))
    ends = c.groupBy("document").agg(F.max("row_no").alias("m"))
    extra = ends.select("document", F.explode(F.array(
        F.struct(F.lit(-1).alias("row_no"), F.array(F.lit("Results")).alias("cells")), F.struct(F.lit(0).alias("row_no"), F.array(F.lit("Name"), F.lit("Segment")).alias("cells")),
        F.struct((F.col("m") + 1).alias("row_no"), F.array(F.lit("page 1")).alias("cells")), F.struct((F.col("m") + 2).alias("row_no"), F.when(F.col("document").like("%5"), F.array(F.lit("Name"), F.lit("Segment"))).otherwise(F.array(F.lit("end"))).alias("cells")))).alias("x")).select("document", "x.*")
    rows = c.unionByName(extra).select("document", F.lit(1).alias("page_number"), "row_no", F.lit(0.0).alias("y"), "cells", F.lit(None).cast("string").alias("error"))
    return pdf_rows.table_block(rows, ["Name", "Segment"]).select("document", "row_no", F.array_join("cells", "|").alias("cells"), "error", "last_of_block")


@query("""SELECT standings_version_id AS season, competitor_id AS name, CAST(CASE WHEN tied THEN standing_rank END AS INT) AS shared_rank, standing_rank AS rank, CASE WHEN points % 5 = 0 THEN 'differs' END AS total
  FROM (SELECT standings_version_id, competitor_id, min(standing_rank) AS standing_rank, max(points) AS points, min(standing_rank) % 2 = 0 AS tied FROM standing_rows WHERE points > 0 AND standing_rank > 0 GROUP BY 1, 2)""")
def src_14_golden_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A wide season table written as CSV files and read again: ranks as T12 or 12, tournament cells that add up to the total, or not."""
    s = table(spark, sf, "standing_rows").where("points > 0 AND standing_rank > 0").groupBy(F.col("standings_version_id").alias("season"), F.col("competitor_id").alias("name")).agg(F.min("standing_rank").alias("r"), F.max("points").alias("p"))
    wide = s.select(F.concat_ws("|", "season", "name").alias("row_name"), F.concat(F.when(F.col("r") % 2 == 0, "T").otherwise(""), "r").alias("rank"), F.when(F.col("p") % 5 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("total"),
                    F.when(F.col("p") > 1, F.lit(1)).alias("t1"), (F.col("p") - F.when(F.col("p") > 1, 1).otherwise(0)).alias("t2"))
    at = _folder(spark, "golden")
    wide.write.option("header", True).option("escape", '"').csv(at)
    read = documents.read_csv(spark, at, "row_name string, rank string, total int, t1 int, t2 int")
    wrong = archives.season_errors(read, ["row_name", "rank", "total"], "row_name", "total").withColumn("_x", F.lit("differs"))
    rank = archives.parse_rank(F.col("rank"))
    name = F.split("row_name", r"\|")
    return read.join(wrong.select("row_name", "_x"), "row_name", "left").select(name[0].alias("season"), name[1].alias("name"), F.when(F.col("rank").startswith("T"), rank).alias("shared_rank"), rank.alias("rank"), F.col("_x").alias("total"))


@query("""SELECT standings_version_id AS season, 'p' AS policy, competitor_id AS name, CAST(max(points) AS INT) AS points, CAST(max(wins) AS INT) AS wins FROM standing_rows GROUP BY 1, 3""")
def src_15_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Season archives written as JSON, a hundred rows a file at most, and read under the closed schema."""
    s = table(spark, sf, "standing_rows").groupBy("standings_version_id", "competitor_id").agg(F.max("points").alias("points"), F.max("wins").alias("wins"))
    part = F.pmod(F.xxhash64("competitor_id"), F.lit(64))
    rows = F.collect_list(F.struct(F.col("competitor_id").alias("name"), "points", "wins"))
    at = _folder(spark, "archive")
    s.groupBy(F.col("standings_version_id").alias("season"), part.alias("_part")).agg(F.lit("p").alias("policy"), rows.alias("standings")).drop("_part").write.json(at)
    return archives.read_archive(spark, at, lines=True).select("season", "policy", "name", "points", "wins")


@query("""SELECT packet, CASE WHEN n <> 6 OR places <> '1,2,3,4,5,6' THEN 'PLACES_INCOMPLETE' ELSE 'NAME_REPEATED' END AS code FROM (SELECT result_set_id AS packet, count(*) AS n, array_to_string(list_sort(list(DISTINCT placement)), ',') AS places, count(DISTINCT lower(trim(published_name))) AS d
  FROM (SELECT DISTINCT id, result_set_id, placement, published_name FROM results WHERE placement BETWEEN 1 AND 6 AND result_set_id IS NOT NULL AND published_name IS NOT NULL) GROUP BY 1) WHERE n <> 6 OR places <> '1,2,3,4,5,6' OR d <> n""")
def src_09_src_10_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("placement BETWEEN 1 AND 6 AND result_set_id IS NOT NULL AND published_name IS NOT NULL").select("id", F.col("result_set_id").alias("packet"), "placement", "published_name").distinct()
    return archives.reviewed_errors(r, "packet", "published_name", "placement")


@query("SELECT id, tier, canonical_name FROM (SELECT DISTINCT id, tier, canonical_name FROM lineages)")
def src_11_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON file a lineage in nested folders (a dimension of fixed size), among files of other kinds."""
    at = _folder(spark, "manifests")
    d = table(spark, sf, "lineages").select("id", "tier", "canonical_name").distinct().withColumn("_dir", F.col("tier"))
    body = F.to_json(F.struct("id", "tier", "canonical_name"))
    d.select("_dir", F.col("id").alias("_file"), body.alias("value")).repartition("_dir", "_file").write.partitionBy("_dir", "_file").text(at)
    return documents.read_manifests(spark, at, "id string, tier int, canonical_name string", glob="*.txt")


@query("""SELECT sha256(n_name || ' of ' || r_name || chr(10)) AS sha256, CAST(length(n_name || ' of ' || r_name) + 1 AS BIGINT) AS length FROM nation JOIN region ON r_regionkey = n_regionkey WHERE length(n_name || ' of ' || r_name) < 18""")
def src_12_bounded_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """One file a nation; those over 18 bytes are never read."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = _folder(spark, "blobs")
    n.select("n_nationkey", F.concat("n_name", F.lit(" of "), "r_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(at)
    return documents.read_blobs(spark, at, 18).where("path LIKE '%.txt'").select("sha256", "length")


@query("""SELECT sha256(text) AS sha256, 'snapshots/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS key, octet_length(encode(text)) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL))""")
def snk_01_put_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of all documents against a manifest that holds every third one already."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    blob = d.select(F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"))
    known = d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), F.lit("text/plain").alias("media_type")).distinct()
    return stores.put_blobs(known, blob)[0].select("sha256", "key", "bytes")


@query("""SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0 AND doc_id % 2 = 0""")
def snk_01_blob_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with other sizes for the contents of even documents: every one of them is a collision."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    blob = d.select(F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"))
    even = d.where("doc_id % 2 = 0 AND octet_length(text) > 0").select(F.sha2("text", 256).alias("sha256"), (F.octet_length("text") + 1).cast("bigint").alias("bytes"), F.lit("text/plain").alias("media_type")).distinct()
    return stores.put_blobs(even, blob)[1]


# Versions ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'standings' AS what, standings_version_id, competitor_id, max(points) AS points FROM standing_rows GROUP BY 2, 3 UNION ALL SELECT 'history', 'v2', '2020-21', 2 UNION ALL SELECT 'history', 'v1', '2020-21', 1
  UNION ALL SELECT 'unchanged', 'h2', 'true', NULL UNION ALL SELECT 'again', 'v2', 'false', NULL UNION ALL SELECT 'other content', 'v2', 'refused', NULL UNION ALL SELECT 'current', 'v2', '2020-21', NULL""")
def snk_03_snk_06_src_13_dml_06_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions are published, one again, one again with other content; the current one is read back."""
    s = table(spark, sf, "standing_rows").groupBy("standings_version_id", "competitor_id").agg(F.max("points").alias("points"))
    v = stores.VersionStore(spark, _folder(spark, "versions"))
    v.publish("v1", "2020-21", "h1", "2021-01-01 00:00:00", {"standings": s.where("points > 10")})
    v.publish("v2", "2020-21", "h2", "2021-02-01 00:00:00", {"standings": s})
    again = v.publish("v2", "2020-21", "h2", "2021-02-01 00:00:00", {"standings": s})
    try:
        v.publish("v2", "2020-21", "h3", "2021-03-01 00:00:00", {"standings": s})
        refused = "published"
    except stores.PublishConflict:
        refused = "refused"
    facts = [("unchanged", "h2", str(v.unchanged("2020-21", "h2")).lower(), None), ("again", "v2", str(again).lower(), None), ("other content", "v2", refused, None), ("current", v.current("2020-21"), "2020-21", None)]
    history = v.history("2020-21").select(F.lit("history"), "version", "season", F.month("created_at"))
    rows = v.table("v2", "standings").select(F.lit("standings").alias("what"), "standings_version_id", "competitor_id", "points")
    return rows.unionAll(history).unionAll(spark.createDataFrame(facts, "what string, a string, b string, points int"))


_KEY = b"engine test key"
_INNER, _OUTER = canon.hmac_pads(_KEY)
_TEXT = "'2024-03-01T00:00:00Z' || chr(10) || sha256(c_comment) || chr(10) || octet_length(encode(c_comment))"


@query(f"""SELECT c_custkey, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode({_TEXT})))) AS signature, CASE WHEN c_custkey % 3 = 1 THEN 'EXPIRED' WHEN c_custkey % 3 = 2 THEN 'BAD_SIGNATURE' END AS error FROM (SELECT c_custkey, c_name AS c_comment FROM customer)""")
def snk_08_signed_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets are signed; every third comes too late, every third is changed on its way."""
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("body"), F.lit("2024-03-01T00:00:00Z").alias("at"), (F.col("c_custkey") % 3).alias("k"))
    signed = d.withColumn("signature", canon.hmac_sha256(_KEY)(canon.packet_text(F.col("at"), F.col("body"))))
    now = F.to_timestamp(F.when(F.col("k") == 1, "2024-03-01 00:05:01").otherwise("2024-03-01 00:05:00"))
    body = F.when(F.col("k") == 2, F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    return signed.select("c_custkey", "signature", canon.packet_error(F.col("at"), body, F.col("signature"), now, _KEY).alias("error"))


@query("SELECT DISTINCT id, '•••' || right(source_person_key, 4) AS mask FROM results")
def prj_12_masked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select("id", text.masked(F.col("source_person_key")).alias("mask")).distinct()


@query("""SELECT e.id AS edition_id, e.season_id, count(a.id) AS awards, CAST(coalesce(sum(a.points), 0) AS BIGINT) AS points, CAST(rank() OVER (PARTITION BY season_id ORDER BY coalesce(sum(a.points), 0) DESC) AS BIGINT) AS place FROM (SELECT DISTINCT id, season_id FROM editions) e LEFT JOIN (SELECT DISTINCT id, edition_id, points FROM awards) a ON a.edition_id = e.id GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY coalesce(sum(a.points), 0) DESC, e.id) <= 100""")
def snk_07_report_top(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred editions of most points a season."""
    d = lambda t, *c: table(spark, sf, t).select(*c).distinct()
    report = views.tournament_report(d("editions", "id", F.lit("l").alias("lineage_id"), "season_id"), d("results", "id", "edition_id"), d("awards", "id", "edition_id", "points"))
    w = Window.partitionBy("season_id").orderBy(F.desc("points"))
    best = report.withColumns({"place": F.rank().over(w).cast("bigint"), "_n": F.row_number().over(Window.partitionBy("season_id").orderBy(F.desc("points"), "edition_id"))})
    return best.where("_n <= 100").select("edition_id", "season_id", "awards", F.col("points").cast("bigint").alias("points"), "place")




_LIMIT = 200_000


@query(f"""SELECT doc_id, CAST(b AS BIGINT) AS bytes_read, CASE WHEN b <= {_LIMIT} THEN sha256(text) END AS sha256, CASE WHEN b > {_LIMIT} THEN 'SOURCE_TOO_LARGE' END AS error FROM (SELECT doc_id, text, sum(coalesce(octet_length(encode(text)), 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS b FROM documents)""")
def stm_13_bounded_reading(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one source in the order of their ids, of which so many bytes may be read."""
    return documents.bounded(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", _LIMIT).select("doc_id", "bytes_read", "sha256", "error")
