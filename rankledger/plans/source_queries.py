"""Sources over whole tables: documents are written as text from the tables, parsed again, and compared by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import table
from ..sources import archives, calendar, documents, pdf_rows, provider

QUERIES: dict = {}
ORACLE: dict = {}
HEADER = ["Name", "School", "Place", "Stage"]
ALIASES = {"competitor": ["name", "competitor"], "school": ["school"], "place": ["place", "rank"], "stage": ["stage"]}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct placed results by set, with ASCII-trimmed texts."""
    r = table(spark, sf, "results").where("result_set_id IS NOT NULL AND placement > 0 AND published_name IS NOT NULL AND furthest_stage IS NOT NULL")
    return r.select("result_set_id", F.trim("published_name").alias("n"), F.trim(F.coalesce("published_school", F.lit(""))).alias("s"), "placement", "furthest_stage").distinct()


def _gathered(rows: DataFrame, line: Column) -> DataFrame:
    """One text list a result set: a published set is one document."""
    return rows.groupBy("result_set_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))


_PLACED_SQL = """SELECT DISTINCT result_set_id AS id, trim(published_name) AS published_name, trim(coalesce(published_school, '')) AS published_school, placement, furthest_stage, placement = 1 AND furthest_stage = 'final' AS won_final_round
  FROM results WHERE result_set_id IS NOT NULL AND placement > 0 AND published_name IS NOT NULL AND furthest_stage IS NOT NULL"""


def _results(tables: DataFrame) -> DataFrame:
    out = documents.document_results(documents.map_columns(tables, ALIASES), "m")
    return out.where("error IS NULL").select("id", "published_name", "published_school", "placement", "furthest_stage", "won_final_round").distinct()


@query(_PLACED_SQL)
def src_03_prj_05_csv_documents(spark: SparkSession, sf: str) -> DataFrame:
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("n", "s", "placement", "furthest_stage")]
    docs = _gathered(_placed(spark, sf), F.concat_ws(",", *quoted))
    return _results(documents.csv_tables(docs.select("result_set_id", F.concat(F.lit(",".join(HEADER) + "\n"), F.array_join("_l", "\n")).alias("body")), "result_set_id", "body"))


@query(_PLACED_SQL)
def src_04_prj_04_json_documents(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array("n", "s", F.col("placement").cast("string"), "furthest_stage")
    docs = _gathered(_placed(spark, sf), cells)
    body = F.to_json(F.struct(F.concat(F.array(F.array(*[F.lit(h) for h in HEADER])), F.col("_l")).alias("rows")))
    return _results(documents.json_tables(docs.select("result_set_id", body.alias("body")), "result_set_id", "body", "rows"))


@query(_PLACED_SQL)
def src_05_str_07_html_documents(spark: SparkSession, sf: str) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(F.col(c).cast("string")), F.lit("</td>")) for c in ("n", "s", "placement", "furthest_stage")], F.lit("</tr>"))
    head = "<table><tbody><tr><td>decoy</td></tr></tbody></table><table id='results'><thead><tr>" + "".join(f"<th>{h}</th>" for h in HEADER) + "</tr></thead><tbody>"
    docs = _gathered(_placed(spark, sf), line).select("result_set_id", F.concat(F.lit(head), F.array_join("_l", ""), F.lit("</tbody></table>")).alias("body"))
    return _results(documents.html_tables(docs, "result_set_id", "body", "results"))


@query("""SELECT DISTINCT source_entry_id AS entry_id, event_key AS event_id, coalesce(source_person_key, 'none') AS person_id, published_name AS name, coalesce(published_school, '') AS school FROM results WHERE edition_id IS NOT NULL AND published_name IS NOT NULL AND source_entry_id IS NOT NULL AND event_key IS NOT NULL""")
def src_01_prj_01_provider_entries(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("edition_id IS NOT NULL AND published_name IS NOT NULL AND source_entry_id IS NOT NULL AND event_key IS NOT NULL")
    r = r.select("edition_id", F.coalesce("published_school", F.lit("")).alias("school"), F.struct(F.col("source_entry_id").alias("id"), F.col("event_key").alias("event"), F.array(F.coalesce("source_person_key", F.lit("none"))).alias("students"), F.col("published_name").alias("name")).alias("e")).distinct()
    schools = r.groupBy("edition_id", "school").agg(F.collect_list("e").alias("entries"))
    body = F.to_json(F.struct(F.lit(1).alias("id"), F.array(F.struct(F.col("school").alias("id"), F.col("school").alias("name"), "entries", F.array().cast("array<struct<id:string>>").alias("students"))).alias("schools"), F.lit("kept").alias("unknown_key")))
    export = provider.parse_exports(schools.select("edition_id", body.alias("body")), "body")
    return provider.entries(export).select("entry_id", "event_id", "person_id", "name", "school").distinct()


@query("""WITH t AS (SELECT edition_id || ':' || event_key AS event_id, source_entry_id AS entry_id, max(CASE furthest_stage WHEN 'octafinal' THEN 1 WHEN 'quarterfinal' THEN 2 WHEN 'semifinal' THEN 3 WHEN 'final' THEN 4 END) AS d FROM results WHERE edition_id IS NOT NULL AND event_key IS NOT NULL AND source_entry_id IS NOT NULL AND furthest_stage IS NOT NULL GROUP BY 1, 2)
  SELECT event_id, entry_id, list_extract(['octafinal', 'quarterfinal', 'semifinal', 'final'], d) AS stage FROM t""")
def prj_03_win_11_agg_08_participation(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").where("edition_id IS NOT NULL AND event_key IS NOT NULL AND source_entry_id IS NOT NULL AND furthest_stage IS NOT NULL")
    r = r.select(F.concat_ws(":", "edition_id", "event_key").alias("event"), "furthest_stage", F.struct(F.col("source_entry_id").alias("entry")).alias("b")).distinct()
    sections = r.groupBy("event", "furthest_stage").agg(F.collect_list("b").alias("ballots"))
    one = F.struct(F.concat_ws("/", "event", "furthest_stage").alias("id"), F.initcap("furthest_stage").alias("label"), F.array(F.struct(F.lit("1").alias("id"), F.lit("1").alias("round"), "ballots")).alias("sections"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("c").alias("id"), F.array(F.struct(F.col("event").alias("id"), F.array(one).alias("rounds"))).alias("events"))).alias("categories")))
    took = provider.participation(provider.events(provider.parse_exports(sections.select(body.alias("body")), "body")))
    depth = F.array_position(F.array(*[F.lit(s) for s in ("octafinal", "quarterfinal", "semifinal", "final")]), F.col("stage")).cast("int")
    best = took.groupBy("event_id", "entry_id").agg(F.max(depth).alias("d"))
    return best.select("event_id", "entry_id", F.try_element_at(F.array(*[F.lit(s) for s in ("octafinal", "quarterfinal", "semifinal", "final")]), F.col("d")).alias("stage"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS document, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS row_no, c_name || '|' || c_mktsegment AS cells FROM customer""")
def src_06_win_07_srt_08_pdf_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two texts a line, five units apart, the second one unit lower: the clustering has to put them back together."""
    c = table(spark, sf, "customer").withColumn("_y", 1e6 - F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) * 5)
    cell = lambda what, x, drop: c.select(F.col("c_nationkey").cast("string").alias("document"), F.lit(1).alias("page_number"), F.col(what).alias("text"), F.lit(x).alias("x"), (F.col("_y") - drop).alias("y"), F.lit(5.0).alias("width"))
    return pdf_rows.cluster_rows(cell("c_name", 1.0, 0.0).unionByName(cell("c_mktsegment", 50.0, 1.0))).select("document", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT policy_version_id AS id, CAST(tier AS VARCHAR) AS tournament, 'https://cal.example/t?tourn_id=' || tier AS href, min_by(canonical_name, id) AS title FROM (SELECT DISTINCT id, policy_version_id, tier, canonical_name FROM lineages) GROUP BY policy_version_id, tier""")
def src_07_flt_16_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """A page of links a policy version; of the links of one tournament the first stays."""
    l = table(spark, sf, "lineages").select("id", "policy_version_id", "tier", "canonical_name").distinct()  # noqa: E741
    link = F.concat(F.lit("<li><a class='x' href=\"/t?tourn_id="), F.col("tier"), F.lit("\"><b>"), F.col("canonical_name"), F.lit("</b></a><a href='http://cal.example/t?tourn_id=1'>plain</a>"))
    pages = l.groupBy("policy_version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", link.alias("k")))), lambda x: x.k), "\n").alias("html"))
    return calendar.calendar_entries(pages, "policy_version_id", "html", "cal.example")


@query("""SELECT standings_version_id AS season, competitor_id AS name, CAST(sum(points) AS BIGINT) AS cells FROM standing_rows WHERE points IS NOT NULL GROUP BY 1, 2""")
def src_14_agg_19_golden_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """A wide season table by points band, unpivoted again: the cells of a row add up to its total."""
    s = table(spark, sf, "standing_rows").where("points IS NOT NULL")
    wide = s.groupBy(F.col("standings_version_id").alias("season"), F.col("competitor_id").alias("name")).agg(*[F.sum(F.when(F.pmod("points", F.lit(3)) == k, F.col("points"))).alias(f"t{k}") for k in range(3)])
    return archives.unpivot_season(wide, ["season", "name"]).groupBy("season", "name").agg(F.sum("points").alias("cells"))


@query("""SELECT DISTINCT id, coalesce(explicit_final = 1, false) AND coalesce(correction = 0, false) AS final FROM result_sets""")
def flt_01_flt_02_finality(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "result_sets").select("id", "explicit_final", F.col("correction").cast("string").alias("bracket")).distinct()
    return r.select("id", provider.explicit_final(F.col("explicit_final").cast("string"), F.lit(" Final "), F.col("bracket")).alias("final"))


@query("""SELECT DISTINCT id, CASE WHEN placement IS NULL THEN 'prelim' END AS dropped FROM results WHERE placement IS NULL""")
def flt_03_preliminary(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").select("id", F.coalesce(F.col("placement").cast("string"), F.lit("prelim")).alias("p")).distinct()
    return r.where(text.is_preliminary(F.col("p"))).select("id", F.col("p").alias("dropped"))
