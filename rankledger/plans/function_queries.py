"""One query for each scalar function family, over whole tables, with SQL where DuckDB has the function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, text, time, url
from ..operators import scoring
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


def nfkc_sql(c: str) -> str:
    """Compatibility forms in SQL, character by character from the layout of their blocks, written apart from the operator."""
    k = "unicode(k)"
    letter = lambda first: f"chr(CAST(CASE WHEN ({k} - {first}) % 52 < 26 THEN 65 ELSE 71 END + ({k} - {first}) % 52 AS INT))"
    ligatures = "['ff','fi','fl','ffi','ffl','st','st']"
    romans = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','L','C','D','M']"
    return f"""nfc_normalize(array_to_string(list_transform(regexp_extract_all({c}, '(?s).'), lambda k: CASE WHEN {k} < 160 THEN k WHEN {k} BETWEEN 65281 AND 65374 THEN chr(CAST({k} - 65248 AS INT)) WHEN {k} BETWEEN 119808 AND 120483 THEN {letter(119808)}
      WHEN {k} BETWEEN 120782 AND 120831 THEN chr(CAST(48 + ({k} - 120782) % 10 AS INT)) WHEN {k} IN (160, 8239, 8287, 12288) OR {k} BETWEEN 8192 AND 8202 THEN ' ' WHEN {k} BETWEEN 64256 AND 64262 THEN list_extract({ligatures}, CAST({k} - 64255 AS INT)) WHEN {k} BETWEEN 8544 AND 8559 THEN list_extract({romans}, CAST({k} - 8543 AS INT))
      WHEN {k} BETWEEN 8560 AND 8575 THEN lower(list_extract({romans}, CAST({k} - 8559 AS INT))) WHEN {k} BETWEEN 9398 AND 9449 THEN {letter(9398)} WHEN {k} = 8209 THEN chr(8208) WHEN {k} = 8230 THEN '...' WHEN {k} = 8482 THEN 'TM' ELSE k END), ''))"""


_BLANK = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def identity_sql(c: str) -> str:
    """``identity_text`` in SQL: apostrophes between letters are put aside while all punctuation goes."""
    t = "lower(" + nfkc_sql(f"trim(regexp_replace({c}, '{_BLANK}', ' ', 'g'))") + ")"
    for _ in range(2):  # neighbouring apostrophes share a letter, so twice
        t = f"regexp_replace({t}, '(\\p{{L}})''(\\p{{L}})', '\\1' || chr(57344) || '\\2', 'g')"
    t = f"regexp_replace(replace({t}, chr(39), ''), '[\\p{{P}}]', '', 'g')"
    return f"nullif(trim(regexp_replace(replace({t}, chr(57344), chr(39)), '{_BLANK}', ' ', 'g')), '')"


@query(f"SELECT {identity_sql('v')} AS identity, CAST(sum(n) AS BIGINT) AS rows, count(*) AS spellings FROM (SELECT published_name AS v, count(*) AS n FROM results GROUP BY 1) GROUP BY 1")
def str_01_identity_text(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "results").groupBy(F.col("published_name").alias("v")).agg(F.count(F.lit(1)).alias("rows"))
    return names.groupBy(text.identity_text(F.col("v")).alias("identity")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("spellings"))


@query("SELECT id, trim(regexp_replace(display_name, '\\s+', ' ', 'g')) AS name FROM (SELECT DISTINCT competitor_id AS id, display_name FROM competitors)")
def str_02_display_name(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "competitors").select(F.col("competitor_id").alias("id"), "display_name").distinct()
    return d.select("id", text.display_name(F.col("display_name")).alias("name"))


@query("SELECT source, trim(regexp_replace(regexp_replace(lower(source), '[_\\W]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key, count(*) AS documents FROM documents GROUP BY 1")
def str_03_exact_key(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return d.select("source", text.exact_key(F.col("source")).alias("key"), "documents")


@query("SELECT id, regexp_replace(trim(regexp_replace(lower(event_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+(online|in person)$', '') AS key FROM (SELECT DISTINCT id, event_name FROM result_sets WHERE event_name IS NOT NULL)")
def str_04_event_key(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "result_sets").where("event_name IS NOT NULL").select("id", "event_name").distinct()
    return d.select("id", text.event_key(F.col("event_name")).alias("key"))


_PLACE = "CASE WHEN placement IS NULL THEN furthest_stage WHEN placement % 3 = 0 THEN placement || 'th' WHEN placement % 7 = 0 THEN 'place ' || placement WHEN placement % 11 = 0 THEN '0' ELSE CAST(placement AS VARCHAR) END"


@query(f"""WITH t AS (SELECT DISTINCT id, {_PLACE} AS raw, furthest_stage FROM results)
SELECT id, raw, CASE WHEN regexp_full_match(trim(raw), '(?i)\\d+(st|nd|rd|th)?') AND CAST(regexp_extract(raw, '\\d+') AS INT) > 0 THEN CAST(regexp_extract(raw, '\\d+') AS INT) END AS place,
  CASE WHEN raw = '0' OR raw LIKE 'place%' AND furthest_stage = 'final' THEN 'INVALID_PLACEMENT' END AS error FROM t""")
def str_06_placement(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "results").select("id", F.expr(_PLACE.replace("VARCHAR", "STRING")).alias("raw"), "furthest_stage").distinct()
    raw = F.col("raw")
    return d.select("id", "raw", text.numeric_placement(raw).alias("place"), text.placement_error(raw, ~F.col("furthest_stage").eqNullSafe("final")).alias("error"))


@query("SELECT id, CASE WHEN regexp_full_match(t, '[1-9][0-9]*') THEN CAST(t AS INT) END AS place FROM (SELECT DISTINCT id, CASE WHEN placement % 2 = 0 THEN '0' || placement ELSE CAST(placement AS VARCHAR) END AS t FROM results)")
def str_07_strict_placement(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE WHEN placement % 2 = 0 THEN concat('0', placement) ELSE CAST(placement AS STRING) END")
    return table(spark, sf, "results").select("id", t.alias("t")).distinct().select("id", text.strict_placement(F.col("t")).alias("place"))


@query("""SELECT id, CASE WHEN lower(event_name) IN ('international extemporaneous speaking','international extemp','ix') THEN 'ix' WHEN lower(event_name) IN ('united states extemporaneous speaking','united states extemp','usx') THEN 'usx' ELSE 'combined' END AS by_key,
  CASE WHEN regexp_matches(event_name, '(?i)international') THEN 'ix' WHEN regexp_matches(event_name, '(?i)national|united states|\\bus extemp') THEN 'usx' ELSE 'combined' END AS by_pattern FROM (SELECT DISTINCT id, event_name FROM result_sets)""")
def str_08_division(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "result_sets").select("id", "event_name").distinct()
    return d.select("id", text.division_by_key(F.col("event_name")).alias("by_key"), text.division_by_pattern(F.col("event_name")).alias("by_pattern"))


@query("""SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 7919 AS VARCHAR)) BETWEEN 5 AND 12 THEN CAST(o_orderkey * 7919 AS VARCHAR) END AS number,
  CASE WHEN length(CAST(o_orderkey * 7919 AS VARCHAR)) BETWEEN 5 AND 12 THEN '•••' || right(CAST(o_orderkey * 7919 AS VARCHAR), 4) END AS mask FROM orders""")
def str_09_member_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.concat(F.lit(" "), F.regexp_replace((F.col("o_orderkey") * 7919).cast("string"), r"(\d{3})", "$1-"), F.lit(" "))
    d = table(spark, sf, "orders").select("o_orderkey", text.member_number(n).alias("number"))
    return d.withColumn("mask", text.masked(F.col("number")))


@query(f"SELECT v, trim(regexp_replace({nfkc_sql('v')}, '{_BLANK}', ' ', 'g')) AS name FROM (SELECT DISTINCT published_name AS v FROM results)")
def str_10_submitted_name(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "results").select(F.col("published_name").alias("v")).distinct()
    return d.select("v", text.collapse(text.nfkc(F.col("v"))).alias("name"))


_TAGS = "regexp_replace(text, '<[^>]*>', ' ', 'g')"
for _n, _c in (("amp", "&"), ("quot", '"'), ("apos", "''"), ("lt", "<"), ("gt", ">")):
    _TAGS = f"regexp_replace({_TAGS}, '(?i)&{_n};', '{_c}', 'g')"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_TAGS}, '[\\s\\x{{85}}\\x{{A0}}\\x{{2002}}\\x{{2003}}\\x{{2009}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))) AS digest FROM documents")
def str_11_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.plain_text(F.col("text"))).alias("digest"))


@query("SELECT source_person_key, CASE WHEN starts_with(source_person_key, 'gridtab:') THEN source_person_key ELSE 'gridtab:' || source_person_key END AS key FROM (SELECT DISTINCT source_person_key FROM results)")
def str_12_person_key(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "results").select("source_person_key").distinct()
    return d.select("source_person_key", text.person_key(F.lit("gridtab"), F.col("source_person_key")).alias("key"))


@query("SELECT s, replace(replace(replace(replace(replace(url_encode(s), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM (SELECT DISTINCT published_school AS s FROM results)")
def str_13_encode_component(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "results").select(F.col("published_school").alias("s")).distinct()
    return d.select("s", text.encode_component(F.col("s")).alias("encoded"))


@query("SELECT DISTINCT lineage_id, row_number() OVER (ORDER BY lineage_id) AS place FROM (SELECT DISTINCT lineage_id FROM editions WHERE lineage_id IS NOT NULL)")
def str_15_code_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf, "editions").select("lineage_id").where("lineage_id IS NOT NULL").distinct()  # a dimension: at most the lineages
    return d.withColumn("place", F.row_number().over(Window.orderBy("lineage_id")).cast("bigint"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY icu_sort_key(name, 'und'), id) AS INT) AS locale_place, CAST(row_number() OVER (ORDER BY name, id) AS INT) AS byte_place FROM (SELECT id, min(canonical_name) AS name FROM lineages GROUP BY 1)")
def str_16_locale_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage names in the order of the UNICODE collation beside byte order (a dimension of fixed size)."""
    from pyspark.sql import Window

    d = table(spark, sf, "lineages").groupBy("id").agg(F.min("canonical_name").alias("name"))
    by = lambda c: F.row_number().over(Window.orderBy(c, "id"))
    return d.select("id", by(F.collate("name", "UNICODE")).alias("locale_place"), by(F.col("name")).alias("byte_place"))


@query("SELECT id, CASE WHEN regexp_matches(s, '[\",\r\n]') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS field FROM (SELECT DISTINCT id, published_school AS s FROM results)")
def str_17_csv_field(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "results").select("id", F.col("published_school").alias("s")).distinct()
    return d.select("id", text.csv_field(F.col("s")).alias("field"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END || '-' || lpad(CAST((CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) % 100 AS VARCHAR), 2, '0') AS season FROM orders")
def dte_01_season_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", time.season_id(F.col("o_orderdate")).alias("season"))


@query("SELECT event_id, CAST(date_trunc('day', ts) + INTERVAL '8 hours 17 minutes' AS VARCHAR) AS bucket FROM events")
def dte_02_daily_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.daily_bucket(F.col("ts")).cast("string").alias("bucket"))


@query("SELECT event_id, CAST(date_trunc('week', ts) + INTERVAL '8 hours 17 minutes' AS VARCHAR) AS bucket FROM events")
def dte_03_weekly_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.weekly_bucket(F.col("ts")).cast("string").alias("bucket"))


@query("SELECT id, season_id, coalesce(regexp_full_match(season_id, '[0-9]{4}-[0-9]{2}') AND CAST(right(season_id, 2) AS INT) = (CAST(left(season_id, 4) AS INT) + 1) % 100, false) AS valid FROM (SELECT DISTINCT id, season_id FROM editions)")
def dte_04_valid_season(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "editions").select("id", "season_id").distinct().withColumn("valid", time.valid_season(F.col("season_id")))


@query("""SELECT y, m, make_timestamp(y + CASE WHEN m >= 8 THEN 0 ELSE 1 END, m, 1, 0, 0, 0.0) AS window_start,
  make_timestamp(y + CASE WHEN m >= 8 THEN 0 ELSE 1 END, m, 1, 0, 0, 0.0) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS window_end
  FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m FROM orders)""")
def dte_05_month_window(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    return d.select(F.col("y").cast("bigint").alias("y"), F.col("m").cast("bigint").alias("m"), time.window_start(F.col("y"), F.col("m")).alias("window_start"), time.window_end(F.col("y"), F.col("m")).alias("window_end"))


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate) AS start_at, date_trunc('day', o_orderdate + INTERVAL 3 DAY) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS end_at, CAST(NULL AS VARCHAR) AS error FROM orders""")
def dte_06_date_range(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    end = d + F.expr("INTERVAL 3 DAYS")
    shown = F.concat(F.date_format(d, "MMMM d"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, ", yyyy")).otherwise(F.lit("")), F.lit(" - "), F.when(F.month(d) == F.month(end), F.lit("")).otherwise(F.date_format(end, "MMM ")), F.date_format(end, "d"))
    o = table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"), time.season_id(d).alias("season"))
    start, finish, error = time.date_range(F.col("shown"), F.col("season"))
    return o.select("o_orderkey", start.alias("start_at"), finish.alias("end_at"), error.alias("error"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS at FROM events")
def dte_07_provider_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.provider_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("string").alias("at"))


@query("""SELECT e.id, greatest(TRY_CAST(e.end_at AS TIMESTAMPTZ), max(TRY_CAST(s.retrieved_at AS TIMESTAMPTZ)))::TIMESTAMP AS later_at FROM (SELECT DISTINCT id, end_at FROM editions) e LEFT JOIN snapshots s ON s.edition_id = e.id GROUP BY e.id, e.end_at""")
def dte_08_later_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "editions").select("id", "end_at").distinct()
    s = table(spark, sf, "snapshots").groupBy("edition_id").agg(F.max(time.instant(F.col("retrieved_at"))).alias("last"))
    return e.join(s, e["id"] == s["edition_id"], "left").select("id", F.greatest(time.instant(F.col("end_at")), F.col("last")).cast("timestamp_ntz").alias("later_at"))


@query("SELECT id, (TRY_CAST(end_at AS TIMESTAMPTZ) + INTERVAL 7 DAY)::TIMESTAMP AS stable_from, (TRY_CAST(end_at AS TIMESTAMPTZ) + INTERVAL 30 DAY)::TIMESTAMP AS overdue_from FROM (SELECT DISTINCT id, end_at FROM editions)")
def dte_09_day_offsets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "editions").select("id", time.instant(F.col("end_at")).alias("t")).distinct()
    return e.select("id", (F.col("t") + F.expr("INTERVAL 7 DAYS")).cast("timestamp_ntz").alias("stable_from"), (F.col("t") + F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz").alias("overdue_from"))


@query("SELECT edition_id, max_by(id, (TRY_CAST(published_at AS TIMESTAMPTZ), id)) AS newest FROM result_sets GROUP BY 1")
def dte_10_instant_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "result_sets")
    return d.groupBy("edition_id").agg(F.max_by("id", F.struct(time.instant(F.col("published_at")), "id")).alias("newest"))


@query("SELECT DISTINCT id, abs(epoch_ms(TRY_CAST(retrieved_at AS TIMESTAMPTZ)) - epoch_ms(ingested_at)) <= 300000 AS in_skew FROM snapshots WHERE retrieved_at IS NOT NULL")
def dte_11_clock_skew(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "snapshots").where("retrieved_at IS NOT NULL")
    return d.select("id", time.within_skew(time.instant(F.col("retrieved_at")), F.col("ingested_at").cast("timestamp")).alias("in_skew")).distinct()


@query("SELECT o_orderkey, CAST((o_orderkey * 5 + 2) // 4 AS INT) AS scaled FROM orders")
def mth_01_half_up(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scoring.half_up(F.col("o_orderkey")).alias("scaled"))


@query("SELECT o_orderpriority AS k, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 END, 0) AS v, count(*) AS orders FROM orders GROUP BY 1")
def map_01_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("1-URGENT"), F.lit(4), F.lit("2-HIGH"), F.lit(3))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("orders")).withColumn("v", F.coalesce(F.try_element_at(m, F.col("k")), F.lit(0)))


_ITEMS = "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1"


@query(f"SELECT l_orderkey, len(list_filter(q, lambda x: x > 25)) > 0 AS any_large, len(list_filter(q, lambda x: x > 5)) = len(q) AS all_over, CAST(list_sum(list_transform(list_filter(q, lambda x: x > 10), lambda x: x * 2)) AS DOUBLE) AS doubled FROM ({_ITEMS})")
def arr_01_quantifiers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    twice = F.transform(F.filter("q", lambda x: x > 10), lambda x: x * 2)
    total = F.when(F.size(twice) > 0, F.aggregate(twice, F.lit(0.0), lambda a, x: a + x))
    return d.select("l_orderkey", F.exists("q", lambda x: x > 25).alias("any_large"), F.forall("q", lambda x: x > 5).alias("all_over"), total.alias("doubled"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, CAST(count(DISTINCT l_returnflag) AS INT) AS n, list_min(list(l_returnflag)) AS first_flag, list_contains(list(l_returnflag), 'R') AS has_r FROM lineitem GROUP BY 1")
def arr_02_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return d.select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.size("flags").alias("n"), F.try_element_at("flags", F.lit(1)).alias("first_flag"), F.array_contains("flags", "R").alias("has_r"))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || ',"nested":{"a":null,"b":' || n_regionkey || '}}' AS canonical FROM nation""")
def jsn_01_canonical(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "nation").withColumn("nested", F.struct(F.col("n_regionkey").alias("b"), F.lit(None).cast("string").alias("a")))
    return d.select("n_nationkey", canon.canonical_json(d).alias("canonical"))


@query("""SELECT DISTINCT edition_id, event_id, '["' || edition_id || '","' || event_id || '",' || coalesce('"' || event_division || '"', 'null') || ']' AS tuple_key FROM result_sets""")
def jsn_02_tuple_key(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "result_sets")
    return d.select("edition_id", "event_id", canon.json_tuple_key(F.col("edition_id"), F.col("event_id"), F.col("event_division")).alias("tuple_key")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_03_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh_01_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT DISTINCT id, 'snapshot:' || sha256('["' || edition_id || '","' || descriptor_id || '","' || sha256 || '"]') AS content_id FROM snapshots WHERE edition_id IS NOT NULL AND descriptor_id IS NOT NULL AND sha256 IS NOT NULL""")
def hsh_02_content_id(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "snapshots").where("edition_id IS NOT NULL AND descriptor_id IS NOT NULL AND sha256 IS NOT NULL")
    return d.select("id", canon.sha256_id("snapshot:", canon.json_tuple_key(F.col("edition_id"), F.col("descriptor_id"), F.col("sha256"))).alias("content_id")).distinct()


_INNER, _OUTER = canon.hmac_pads(b"test key")


@query(f"SELECT c_custkey, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(c_name)))) AS pseudonym FROM customer")
def hsh_03_hmac(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", canon.hmac_sha256(b"test key")(F.col("c_name")).alias("pseudonym"))


@query("""SELECT DISTINCT id, regexp_extract(url, '^https://([^/]+)/', 1) AS host, starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://[^/]*[@:]') AND regexp_extract(url, '^https://([^/]+)/', 1) IN ('tab0.example', 'tab1.example', 'tab2.example') AS allowed,
  CASE WHEN regexp_matches(url, '[?&]tourn_id=[0-9]+(&|$)') THEN regexp_extract(url, '[?&]tourn_id=([0-9]+)', 1) END AS tournament FROM snapshots WHERE url IS NOT NULL""")
def url_01_source_url(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "snapshots").where("url IS NOT NULL").select("id", "url").distinct()
    hosts = F.array(F.lit("TAB0.example"), F.lit("tab1.example"), F.lit("tab2.example"))
    return d.select("id", F.try_parse_url("url", F.lit("HOST")).alias("host"), url.allowed_source(F.col("url"), hosts).alias("allowed"), url.digits_param(F.col("url"), "tourn_id").alias("tournament"))


@query("SELECT id, coalesce(nullif(trim(event_name), ''), event_id) AS label FROM (SELECT DISTINCT id, event_name, event_id FROM result_sets)")
def cnd_01_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "result_sets").select("id", "event_name", "event_id").distinct()
    return d.select("id", F.coalesce(F.nullif(F.trim("event_name"), F.lit("")), "event_id").alias("label"))


@query("SELECT event_id, CAST(CASE least(greatest(user_id % 6, 1), 3) WHEN 1 THEN 900 WHEN 2 THEN 3600 ELSE 21600 END AS INT) AS delay_seconds FROM events")
def stm_04_retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.retry_delay((F.col("user_id") % 6).cast("int")).alias("delay_seconds"))
