"""Placement and elimination scoring as one CASE chain inside whole-stage codegen; no UDF, no driver state.

Input columns: placement (int, nullable), furthest_stage, tier, top_six_only, final_credit_limit.
Checks come in a fixed order and the first failing one names ``error_code``; such a row has null points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points for places 1-6, then semifinal, quarterfinal and octafinal, by tier.
PLACEMENT_POINTS = {2: [150, 120, 105, 75, 60, 50], 3: [100, 85, 70, 50, 40, 33], 4: [70, 60, 49, 35, 28, 23], 5: [40, 34, 28, 20, 16, 13]}
ELIMINATION_POINTS = {2: {"semifinal": 38, "quarterfinal": 23, "octafinal": 8}, 3: {"semifinal": 25, "quarterfinal": 15}, 4: {"semifinal": 18}, 5: {}}
# The national table, its elimination buckets, winner bonus and multiplier.
NATIONAL_POINTS = [200, 170, 140, 100, 80, 66, 50, 48, 46, 44, 40, 38, 36, 34]
NATIONAL_ELIMINATION = {"quarterfinal": 30, "octafinal": 10}
NATIONAL_BONUS = 40
NATIONAL_MULTIPLIER = (5, 4)
STAGES = ["octafinal", "quarterfinal", "semifinal", "final"]


def half_up(value: Column, numerator: int = 5, denominator: int = 4) -> Column:
    """(v*n + d/2) div d, in integers throughout; the denominator is even and the value not negative."""
    return F.call_function("div", value * numerator + denominator // 2, F.lit(denominator)).cast("int")


def _by_tier(per_tier: dict[int, Column]) -> Column:
    out = F.lit(0)
    for tier, value in per_tier.items():
        out = F.when(F.col("tier") == tier, value).otherwise(out)
    return out


def placement_points() -> Column:
    return _by_tier({t: F.try_element_at(F.array(*[F.lit(x) for x in v]), F.col("placement")) for t, v in PLACEMENT_POINTS.items()})


def elimination_points(stage: Column) -> Column:
    def pick(points: dict[str, int]) -> Column:
        out = F.lit(0)
        for name, value in points.items():
            out = F.when(stage == name, value).otherwise(out)
        return out

    return _by_tier({t: pick(v) for t, v in ELIMINATION_POINTS.items()})


def error_code() -> Column:
    p = F.col("placement")
    return (
        F.when(F.col("tier").isNull(), "UNKNOWN_TOURNAMENT").when(p < 1, "INVALID_PLACEMENT")
        .when((p <= 6) & ~F.col("furthest_stage").eqNullSafe("final"), "CONTRADICTORY_STAGE")
    )


def score(df: DataFrame) -> DataFrame:
    """Adds error_code, points, scoring_rule, win, top_three and final_credit."""
    p, placed = F.col("placement"), F.coalesce(F.col("placement") <= 6, F.lit(False))
    stage = F.when(F.col("furthest_stage") == "final", "semifinal").otherwise(F.col("furthest_stage"))
    shut = F.coalesce(F.col("top_six_only"), F.lit(False)) & ~placed
    bucket = elimination_points(stage)
    ok = F.col("error_code").isNull()
    df = df.withColumn("error_code", error_code())
    return df.withColumns({
        "points": F.when(~ok, None).when(shut, 0).when(placed, placement_points()).otherwise(bucket),
        "scoring_rule": F.when(~ok, None).when(shut, "mba-top-six-only").when(placed, "placement").when(bucket > 0, F.concat(stage, F.lit("-bucket"))).otherwise("no-eligible-bucket"),
        "win": ok & placed & (p == 1),
        "top_three": ok & placed & (p <= 3),
        "final_credit": ok & placed & (p <= F.col("final_credit_limit")),
    })


def score_national(df: DataFrame) -> DataFrame:
    """The national rule: needs placement, furthest_stage, division, bonus_division, won_final_round."""
    p, stage = F.col("placement"), F.col("furthest_stage")
    won = F.coalesce(F.col("won_final_round"), F.lit(False))
    error = (
        F.when(p < 1, "INVALID_PLACEMENT").when((p <= 6) & ~stage.eqNullSafe("final"), "CONTRADICTORY_STAGE")
        .when(won & ~F.coalesce((stage == "final") & p.between(1, 6), F.lit(False)), "CONTRADICTORY_FINAL_ROUND")
    )
    placed = F.try_element_at(F.array(*[F.lit(x) for x in NATIONAL_POINTS]), F.when(p.between(1, len(NATIONAL_POINTS)), p))
    base = F.coalesce(placed, F.when(stage == "quarterfinal", NATIONAL_ELIMINATION["quarterfinal"]).when(stage == "octafinal", NATIONAL_ELIMINATION["octafinal"]).otherwise(0))
    strong = F.coalesce(F.col("bonus_division") == F.col("division"), F.lit(False))
    n, d = NATIONAL_MULTIPLIER
    scaled = lambda v: F.when(strong, half_up(v, n, d)).otherwise(v)
    ok = F.col("error_code").isNull()
    df = df.withColumn("error_code", error)
    return df.withColumns({
        "points": F.when(ok, scaled(base) + F.when(won, scaled(F.lit(NATIONAL_BONUS))).otherwise(0)),
        "scoring_rule": F.when(ok, F.concat(F.when(strong, "nsda-strong-field").otherwise("nsda-base"), F.when(won, "-final-round-winner").otherwise(""))),
        "win": ok & F.coalesce(p == 1, F.lit(False)), "top_three": ok & F.coalesce(p <= 3, F.lit(False)), "final_credit": ok & F.coalesce(p <= 6, F.lit(False)),
    })
