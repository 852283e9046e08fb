"""Published season tables: the wide golden CSV and the historical archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "season string, policy string, standings array<struct<rank: int, name: string, school: string, points: int, wins: int, topThrees: int, finals: int>>"


def read_archive(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a standing of every archive; one JSON object a file, or one a line."""
    d = spark.read.schema(ARCHIVE).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return d.select("season", "policy", F.explode("standings").alias("s")).select("season", "policy", "s.*")


def parse_rank(c):
    """'12' or 'T12' as (rank, tied)."""
    return F.regexp_extract(c, r"^T?([1-9]\d*)$", 1).try_cast("int")


def unpivot_season(wide: DataFrame, fixed: list[str]) -> DataFrame:
    """One row a person and tournament with points; blank cells give none."""
    tournaments = [c for c in wide.columns if c not in fixed]
    return wide.unpivot(fixed, tournaments, "tournament", "points").where("points IS NOT NULL")


def season_errors(wide: DataFrame, fixed: list[str], name: str, total: str) -> DataFrame:
    """Rows whose tournament cells do not add up to the published total."""
    sums = unpivot_season(wide, fixed).groupBy(name).agg(F.sum("points").alias("cells"))
    return wide.select(name, total).join(sums, name, "left").where(F.coalesce("cells", F.lit(0)) != F.coalesce(total, F.lit(0)))


def reviewed_errors(packets: DataFrame, packet: str, name: str, place: str, places: int = 6) -> DataFrame:
    """(packet, code) of reviewed packets that do not name exactly the places 1..n, or one name twice."""
    key = F.lower(F.trim(name))
    g = packets.groupBy(packet).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(place)).alias("_p"), F.count_distinct(key).alias("_d"))
    want = F.array(*[F.lit(i) for i in range(1, places + 1)])
    code = F.when((F.col("_n") != places) | (F.col("_p") != want), "PLACES_INCOMPLETE").when(F.col("_d") != F.col("_n"), "NAME_REPEATED")
    return g.select(packet, code.alias("code")).where("code IS NOT NULL")


def single_packet(packets: DataFrame, packet: str) -> DataFrame:
    """The rows of the only reviewed packet; none if there is no packet, ValueError if there are several."""
    if packets.select(packet).distinct().limit(2).count() > 1:
        raise ValueError("more than one reviewed packet")
    return packets
