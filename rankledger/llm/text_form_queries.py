"""Queries of the look-alike text problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.function_queries import nfkc_sql
from ..runtime import table
from .canonical import add_form, not_plain_ascii

FIELDS = ["published_name", "published_school"]


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, field_name, value) of every non-null value; aliases are decoded, one row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("p")
    typed = table(spark, sf_dir, "results").select(F.lit("results").alias("table_name"), F.col("id").alias("row_id"), pairs).select("table_name", "row_id", "p.field_name", "p.value")
    aliases = table(spark, sf_dir, "lineages").select(F.lit("lineages").alias("table_name"), F.col("id").alias("row_id"), F.lit("aliases_json").alias("field_name"), F.explode(F.from_json("aliases_json", "array<string>")).alias("value"))
    return typed.unionByName(aliases).where("value IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspects = field_values(spark, sf_dir).where(not_plain_ascii(F.col("value")))
    return add_form(suspects, "value").where("form <> value AND row_id IS NOT NULL").select("table_name", "row_id", "field_name").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical form: how many spellings and rows it stands for, and how many of the rows needed it."""
    values = field_values(spark, sf_dir).groupBy("table_name", "field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    plain = values.where(~not_plain_ascii(F.col("value"))).withColumn("form", F.col("value"))
    formed = plain.unionByName(add_form(values.where(not_plain_ascii(F.col("value"))), "value"))
    return formed.groupBy("table_name", "field_name", "form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("value_rows"), F.sum(F.when(F.col("form") != F.col("value"), F.col("n")).otherwise(0)).alias("changed_rows"))


_VALUES = """(SELECT 'results' AS table_name, id AS row_id, 'published_name' AS field_name, published_name AS value FROM results WHERE published_name IS NOT NULL
  UNION ALL SELECT 'results', id, 'published_school', published_school FROM results WHERE published_school IS NOT NULL
  UNION ALL SELECT * FROM (SELECT 'lineages', id, 'aliases_json', unnest(from_json(aliases_json, '["VARCHAR"]')) AS a FROM lineages) WHERE a IS NOT NULL)"""

#: Written apart from the operator, by the properties of characters: what no plain typist writes. Twins are listed by their own shapes here.
_ODD = f"""(regexp_matches(value, '[\\p{{Cc}}\\p{{Cf}}\\p{{Zl}}\\p{{Zp}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{2800}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}]') OR regexp_matches(replace(value, ' ', ''), '\\p{{Zs}}') OR nfc_normalize(value) <> value
  OR regexp_matches(value, '[\\x{{FF01}}-\\x{{FFEE}}\\x{{1D400}}-\\x{{1D7FF}}\\x{{2100}}-\\x{{2115}}\\x{{2118}}-\\x{{2121}}\\x{{2123}}-\\x{{214F}}\\x{{2150}}-\\x{{217F}}\\x{{2460}}-\\x{{24FF}}\\x{{2070}}-\\x{{209C}}\\x{{FB00}}-\\x{{FB06}}\\x{{1F100}}-\\x{{1F16F}}\\x{{1D00}}-\\x{{1D22}}]')
  OR (regexp_matches(value, '\\p{{Latin}}') AND len(list_filter(string_split(value, ' '), lambda w: regexp_matches(w, '[\\x{{2010}}\\x{{2011}}\\x{{2212}}\\x{{251}}\\x{{261}}\\x{{269}}\\p{{Armenian}}\\p{{Cherokee}}]')
    OR (regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]')) OR regexp_full_match(w, '[^\\p{{L}}]*[АВЕЅІЈКМНОРСТУХаеѕіјорсухһΑΒΕΖΗΙΚΜΝΟΡΤΥΧον][^\\p{{L}}]*')
    OR regexp_full_match(w, '[АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ.''-]*[АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ][АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ.''-]*') OR regexp_full_match(w, '[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρυ.''-]*[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρυ][ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρυ.''-]*'))) > 0))"""

# Letters of other scripts and their Latin twins, listed here by name of the letters' usual order, apart from the operator's.
_CYR, _CYR_LATIN = "АВЕЁЅІЇЈКМНОРСТУХаеёѕіїјорсухһԁԛԝ", "ABEËSIÏJKMHOPCTYXaeësiïjopcyxhdqw"
_GRE, _GRE_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυάίό", "ABEZHIKMNOPTYXaikvopuáíó"
_REST, _REST_LATIN = "ɑɡɩ‐‑−", "agi---"


def _plain_form(v: str) -> str:
    """The form of a value in SQL written apart from the operator: blocks of compatibility letters by their layout, words by their letters."""
    seen = f"regexp_replace(regexp_replace({v}, '[\\t-\\r\\x{{85}}\\p{{Zs}}\\p{{Zl}}\\p{{Zp}}\\x{{2800}}]', ' ', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    only = lambda text, own: f"translate({text}, '{own}', '')"
    whole = lambda script, own: f"(regexp_matches({only('w', own)}, '{script}') OR (regexp_matches({only('t', own)}, '{script}') AND regexp_matches(w, '{script}') AND NOT regexp_matches({only('t', _CYR_LATIN + _GRE_LATIN)}, '[A-Za-z]')))"
    word = f"""CASE WHEN {whole('\\p{Cyrillic}', _CYR)} THEN translate(translate(w, '{_GRE}', '{_GRE_LATIN}'), '{_CYR_LATIN}', '{_CYR}') WHEN {whole('\\p{Greek}', _GRE)} THEN translate(translate(w, '{_CYR}', '{_CYR_LATIN}'), '{_GRE_LATIN}', '{_GRE}')
      ELSE translate(w, '{_CYR + _GRE + _REST}', '{_CYR_LATIN + _GRE_LATIN + _REST_LATIN}') END"""
    return f"list_extract(list_transform([{nfkc_sql(seen)}], lambda t: CASE WHEN regexp_matches(t, '\\p{{Latin}}') THEN array_to_string(list_transform(string_split(t, ' '), lambda w: {word}), ' ') ELSE t END), 1)"


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLE = {
    "p2_found": f"SELECT DISTINCT table_name, row_id, field_name FROM {_VALUES} WHERE {_ODD}",
    "p2_forms": f"""SELECT table_name, field_name, form, count(DISTINCT value) AS spellings, count(*) AS value_rows, CAST(sum(CASE WHEN form <> value THEN 1 ELSE 0 END) AS BIGINT) AS changed_rows
      FROM (SELECT *, CASE WHEN {_ODD} THEN {_plain_form('value')} ELSE value END AS form FROM {_VALUES}) GROUP BY 1, 2, 3""",
}
