"""Best award per person and edition, season standings with shared ranks, frozen leading table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["points", "wins", "top_threes", "finals"]


def _best_first(division: str, tie: list[str]) -> list[Column]:
    return [(-F.col("points")).alias("_p"), F.coalesce(F.col("placement"), F.lit(2**31 - 1)).alias("_l"), F.col(division), *[F.col(c) for c in tie]]


def max_per_edition(df: DataFrame, edition: list[str], person: str, tie: list[str], division: str = "division") -> DataFrame:
    """One row per (edition, person): most points, then smaller placement (null last), division, tie columns.

    An aggregate, not a window: min_by combines on the map side, so an edition with a third of the rows is no hot task.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in (*edition, person)])
    best = df.groupBy(*edition, person).agg(F.min_by(row, F.struct(*_best_first(division, tie))).alias("_r"))
    return best.select(*edition, person, "_r.*")


def standings(awards: DataFrame, season: list[str], person: str) -> DataFrame:
    """Per season and person: summed metrics and competition rank (equal on all four share it: 1, 2, 2, 4)."""
    total = awards.groupBy(*season, person).agg(
        F.sum("points").cast("bigint").alias("points"), F.count_if("win").alias("wins"), F.count_if("top_three").alias("top_threes"), F.count_if("final_credit").alias("finals"))
    return competition_rank(total, season)


def competition_rank(total: DataFrame, season: list[str]) -> DataFrame:
    """rank() over a season without one task per season: ranks come from the distinct metric tuples.

    Distinct tuples of a season are far fewer than its rows and are counted with map-side combine; only they are
    ordered in a window, and the rank joins back on the tuple.
    """
    w = Window.partitionBy(*season).orderBy(*[F.desc(m) for m in METRICS]).rowsBetween(Window.unboundedPreceding, -1)
    tuples = total.groupBy(*season, *METRICS).agg(F.count(F.lit(1)).alias("_n"))
    ranked = tuples.withColumn("standing_rank", F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).drop("_n")
    return total.join(ranked, [*season, *METRICS])


def frozen_top(total: DataFrame, season: list[str], n: int, name_order: list[str]) -> DataFrame:
    """The first n rows of each season by metrics, then names: positional, so ties do not widen it.

    Where the ranks are there already, only rows of rank n or better are ordered: the leaders and their ties.
    """
    if "standing_rank" in total.columns:
        total = total.where(F.col("standing_rank") <= n)
    w = Window.partitionBy(*season).orderBy(*[F.desc(m) for m in METRICS], *name_order)
    return total.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
