"""Streams over the events table, run to their end, beside their batch SQL; and sink and view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, store, views
from ..runtime import table
from ..streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_BUCKET = "date_trunc('day', ts) + INTERVAL '8 hours 17 minutes'"


@query(f"SELECT user_id AS job_key, CAST({_BUCKET} AS VARCHAR) AS bucket, count(*) AS events FROM events GROUP BY 1, 2")
def stm_01_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.job_rows(table(spark, sf, "events"), "user_id", "ts", "collect")
    return e.groupBy("job_key", F.col("scheduled_for").cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


@query(f"""SELECT DISTINCT sha256('["collect","' || user_id || '","' || strftime({_BUCKET}, '%Y-%m-%d %H:%M:%S') || '"]') AS job_id, user_id AS job_key FROM events""")
def stm_02_dedup(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.job_rows(jobs.read_stream(spark, sf, "events"), "user_id", "ts", "collect")
    return jobs.run_to_end(jobs.dedup_jobs(stream)).select("job_id", "job_key")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 5 = 0 AS ok, count(*) FILTER (event_id % 5 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events)
  SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(n AS INT) AS attempts, CASE WHEN ok THEN 'succeeded' WHEN n >= 4 THEN 'dead_lettered' ELSE 'retrying' END AS state, CAST(CASE WHEN NOT ok AND n < 4 THEN CASE n WHEN 1 THEN 900 WHEN 2 THEN 3600 ELSE 21600 END END AS INT) AS wait_seconds FROM t WHERE n <= 4 AND done = 0""")
def stm_03_stm_12_retry_states(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.read_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("ok"))
    return jobs.run_to_end(jobs.retry_states(e))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_at, CAST(max(ts) + INTERVAL 1 DAY AS VARCHAR) AS closes_at, count(*) AS events FROM h GROUP BY user_id, k""")
def stm_06_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = jobs.quiet_sessions(e, "user_id", "ts", "1 day")
    return s.select("user_id", F.col("from").cast("string").alias("first_at"), F.col("until").cast("string").alias("closes_at"), "events")


@query("""SELECT e.id, (TRY_CAST(e.end_at AS TIMESTAMPTZ) + INTERVAL 30 DAY <= TIMESTAMPTZ '2020-01-01 00:00:00+00') AND e.id NOT IN (SELECT edition_id FROM snapshots WHERE edition_id IS NOT NULL) AS not_held FROM (SELECT DISTINCT id, end_at FROM editions) e""")
def stm_07_not_held(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "editions").select("id", "end_at").distinct()
    have = table(spark, sf, "snapshots").where("edition_id IS NOT NULL").select(F.col("edition_id").alias("id")).distinct().withColumn("_h", F.lit(True))
    over = F.expr("try_cast(end_at AS timestamp) + INTERVAL 30 DAYS") <= F.lit("2020-01-01 00:00:00").cast("timestamp")
    return e.join(have, "id", "left").select("id", F.when(F.col("_h"), F.lit(False)).otherwise(over).alias("not_held"))


@query("""WITH r AS (SELECT DISTINCT edition_id, id, TRY_CAST(published_at AS TIMESTAMPTZ) AS t, explicit_final = 1 AS f FROM result_sets WHERE edition_id IS NOT NULL), m AS (SELECT edition_id, min(t) FILTER (f) AS m FROM r GROUP BY 1)
  SELECT r.edition_id, r.id, CASE WHEN m IS NULL OR t < m THEN 'provisional' WHEN t = m THEN 'final' ELSE 'corrected' END AS status FROM r JOIN m USING (edition_id)""")
def stm_08_late_evidence(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "result_sets").where("edition_id IS NOT NULL").select("edition_id", "id", F.expr("try_cast(published_at AS timestamp)").alias("t"), (F.col("explicit_final") == 1).alias("f")).distinct()
    return jobs.versions_of_late_evidence(r, "edition_id", "t", "f").select("edition_id", "id", "status")


@query("SELECT event_type, count(*) AS n, CAST(sum(value) AS DECIMAL(18, 4)) AS total FROM (SELECT event_type, CAST(value AS DECIMAL(18, 4)) AS value FROM events) GROUP BY 1")
def stm_foreach_batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches append partial sums to a table; the read side adds them up, so a replayed batch id writes the same file."""
    from ..runtime import scratch_root
    import uuid

    at = f"{scratch_root(spark)}/totals-{uuid.uuid4().hex[:8]}"

    def each(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
        part.write.mode("overwrite").parquet(f"{at}/batch={number}")

    jobs.run_batches(jobs.read_stream(spark, sf, "events"), each)
    return spark.read.parquet(at).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(18,4)").alias("total"))


@query("SELECT r_regionkey, 'n_nationkey,n_name' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(13) || chr(10), '' ORDER BY n_nationkey) AS csv FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def snk_05_csv(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return views.csv_lines(n, ["n_nationkey", "n_name"], ["r_regionkey"], ["n_nationkey"], "n_nationkey,n_name")


@query("""SELECT '{"standings_version_id":"' || standings_version_id || '","competitor_id":"' || competitor_id || '","points":' || coalesce(CAST(points AS VARCHAR), 'null') || '}' AS json FROM standing_rows""")
def snk_04_prj_11_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.json_rows(table(spark, sf, "standing_rows"), ["standings_version_id", "competitor_id", "points"])


@query("""SELECT e.id AS edition_id, e.lineage_id, e.season_id, coalesce(r.n, 0) AS results, coalesce(a.n, 0) AS awards, CAST(coalesce(a.p, 0) AS BIGINT) AS points, r.n IS NOT NULL AND a.n IS NOT NULL AS complete
  FROM (SELECT DISTINCT id, lineage_id, season_id FROM editions) e LEFT JOIN (SELECT edition_id, count(DISTINCT id) AS n FROM results GROUP BY 1) r ON r.edition_id = e.id
  LEFT JOIN (SELECT edition_id, count(*) AS n, sum(points) AS p FROM (SELECT DISTINCT id, edition_id, points FROM awards) GROUP BY 1) a ON a.edition_id = e.id""")
def snk_07_agg_09_jon_28_report(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda t, *c: table(spark, sf, t).select(*c).distinct()
    return views.tournament_report(d("editions", "id", "lineage_id", "season_id"), d("results", "id", "edition_id"), d("awards", "id", "edition_id", "points"))


@query("SELECT id, min(descriptor_id) AS descriptor_id, min(sha256) AS sha256 FROM snapshots WHERE id NOT IN (SELECT snapshot_id FROM result_sets WHERE snapshot_id IS NOT NULL) GROUP BY 1")
def dml_01_snk_02_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "snapshots").select("id", "descriptor_id", "sha256").where("id IS NOT NULL")
    have = table(spark, sf, "result_sets").where("snapshot_id IS NOT NULL").select(F.col("snapshot_id").alias("id"))
    return store.insert_ignore(have, new, ["id"])


@query("""SELECT id, coalesce(r.policy, e.policy) AS policy FROM (SELECT DISTINCT id, lineage_id, policy_version_id AS policy FROM editions) e LEFT JOIN (SELECT id AS lid, min(policy_version_id) AS policy FROM lineages GROUP BY 1) r ON r.lid = e.lineage_id""")
def dml_04_backfill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "editions").select("id", "lineage_id", "policy_version_id").distinct()
    l = table(spark, sf, "lineages").groupBy(F.col("id").alias("lineage_id")).agg(F.min("policy_version_id").alias("_p"))  # noqa: E741
    return e.join(l, "lineage_id", "left").select("id", F.coalesce("_p", "policy_version_id").alias("policy"))


@query("""SELECT id, CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) THEN 'SHA256' WHEN NOT coalesce(starts_with(url, 'https://'), false) THEN 'URL' WHEN source_class IS NULL THEN 'SOURCE_CLASS' WHEN permission IS DISTINCT FROM descriptor_permission THEN 'PERMISSION' WHEN media_type IS NULL THEN 'MEDIA_TYPE' END AS error_code
  FROM (SELECT DISTINCT id, sha256, url, source_class, permission, descriptor_permission, media_type FROM snapshots)""")
def val_01_val_03_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "snapshots").select("id", "sha256", "url", "source_class", "permission", "descriptor_permission", "media_type").distinct()
    rules = [("SHA256", F.col("sha256").rlike("^[0-9a-f]{64}$")), ("URL", F.col("url").startswith("https://")), ("SOURCE_CLASS", F.col("source_class").isNotNull()), ("PERMISSION", F.col("permission").eqNullSafe(F.col("descriptor_permission"))), ("MEDIA_TYPE", F.col("media_type").isNotNull())]
    return s.select("id", checks.first_failure(rules).alias("error_code"))


@query("SELECT id, coalesce(source_person_key, 'document:entry:' || sha256('[\"' || coalesce(edition_id, '') || '\",\"' || coalesce(source_entry_id, '') || '\"]')) AS person FROM (SELECT DISTINCT id, source_person_key, edition_id, source_entry_id FROM results)")
def prj_10_synthetic_person(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").select("id", "source_person_key", "edition_id", "source_entry_id").distinct()
    made = F.concat(F.lit("document:entry:"), F.sha2(F.to_json(F.array(F.coalesce("edition_id", F.lit("")), F.coalesce("source_entry_id", F.lit("")))), 256))
    return r.select("id", F.coalesce("source_person_key", made).alias("person"))
