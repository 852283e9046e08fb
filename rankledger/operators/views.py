"""Published views: the season table as CSV text and JSON, public columns only, and the batch report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field

PUBLIC = ["standing_rank", "competitor_id", "display_name", "display_school", "points", "wins", "top_threes", "finals"]
CSV_HEADER = "rank,competitor_id,name,school,points,wins,top_threes,finals"


def csv_lines(rows: DataFrame, columns: list[str], group: list[str], order: list[str], header: str) -> DataFrame:
    """(group, csv): minimal quoting, CRLF, one closing line break only if there are rows.

    A published table is bounded (one season's competitors); larger tables are written by ``csv_lines``' line column
    with a text sink instead of being gathered.
    """
    line = F.concat_ws(",", *[F.coalesce(csv_field(F.col(c)), F.lit("")) for c in columns])
    gathered = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return gathered.select(*group, F.concat(F.lit(header + "\r\n"), F.array_join(F.transform("_l", lambda x: F.concat(x["_line"], F.lit("\r\n"))), "")).alias("csv"))


def json_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row, of the public columns only."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def tournament_report(editions: DataFrame, results: DataFrame, awards: DataFrame) -> DataFrame:
    """Per edition: results, awards and whether it is complete; editions without either stay, with zeros."""
    r = results.groupBy("edition_id").agg(F.count(F.lit(1)).alias("results"))
    a = awards.groupBy("edition_id").agg(F.count(F.lit(1)).alias("awards"), F.sum("points").alias("points"))
    e = editions.select(F.col("id").alias("edition_id"), "lineage_id", "season_id")
    out = e.join(r, "edition_id", "left").join(a, "edition_id", "left")
    return out.select("edition_id", "lineage_id", "season_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("results", "awards", "points")], (F.col("results").isNotNull() & F.col("awards").isNotNull()).alias("complete"))


def modal_school(rows: DataFrame, person: str, school: str) -> DataFrame:
    """Most frequent school of a person; ties by the smaller name."""
    n = rows.where(F.col(school).isNotNull()).groupBy(person, school).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(person).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(school).alias("s"))).alias("x")).select(person, F.col("x.s").alias(school))
