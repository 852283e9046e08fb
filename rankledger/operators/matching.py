"""Candidates matched to lineage fingerprints by rules of falling precedence.

Each rule is an equi-join on a normalized key (platform key, past-edition key, title with organizer), so candidates and
fingerprints meet on keys only. Per fingerprint the first rule with a match decides: one candidate wins, several make it
ambiguous. A pair that a hard rule rejects never matches; its first broken rule is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import exact_key

RULES = ["verified-platform-key", "official-past-edition", "exact-facts"]


def _keys(df: DataFrame, id_column: str, values: Column) -> DataFrame:
    return df.select(F.col(id_column), F.explode(values).alias("_v")).select(id_column, exact_key(F.col("_v")).alias("_k")).where("_k <> ''").distinct()


def _key_sets(df: DataFrame, id_column: str, values: str, name: str) -> DataFrame:
    """(id, set of normalized values): a row's own short list, not a group of the table."""
    return _keys(df, id_column, F.col(values)).groupBy(id_column).agg(F.collect_set("_k").alias(name))


def rejection() -> Column:
    """First hard rule that a joined (candidate, fingerprint) row breaks."""
    season = time.season_start(F.col("start_at"))
    outside = (F.col("start_at") < time.window_start(season, F.col("start_month"))) | (F.col("end_at") > time.window_end(season, F.col("end_month")))
    organizer = F.col("organizer").isNotNull() & ~F.coalesce(F.array_contains("_organizers", F.col("_organizer")), F.lit(False))
    return (
        F.when(organizer, "ORGANIZER_CONTRADICTION").when(F.col("independent_overlap"), "INDEPENDENT_OVERLAP").when(F.col("middle_school_only"), "MIDDLE_SCHOOL_ONLY")
        .when(F.col("start_at").isNull() | F.col("end_at").isNull() | (F.col("end_at") < F.col("start_at")), "MALFORMED_CANDIDATE").when(outside, "OUTSIDE_LINEAGE_WINDOW")
        .when(~F.coalesce(F.arrays_overlap("_events", "_labels"), F.lit(False)), "NO_ELIGIBLE_EVENT")
    )


def match_lineages(candidates: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lineage_id, candidate_id, basis, ambiguous), (lineage_id, candidate_id, reason)).

    candidates: candidate_id, title, start_at, end_at, organizer, event_labels, platform_key, past_key,
    middle_school_only, independent_overlap. fingerprints: lineage_id, names, organizers, labels, platform_keys,
    past_keys, start_month, end_month.
    """
    c_keys = [
        _keys(candidates, "candidate_id", F.array("platform_key")), _keys(candidates, "candidate_id", F.array("past_key")), _keys(candidates.where("organizer IS NOT NULL"), "candidate_id", F.array("title")),
    ]
    f_keys = [_keys(fingerprints, "lineage_id", F.col(c)) for c in ("platform_keys", "past_keys", "names")]
    pairs = reduce(DataFrame.unionByName, [c.join(f, "_k").select("candidate_id", "lineage_id", F.lit(i).alias("_rule")) for i, (c, f) in enumerate(zip(c_keys, f_keys))]).distinct()
    known = fingerprints.select("lineage_id", "start_month", "end_month")
    for column, name in (("organizers", "_organizers"), ("labels", "_labels")):
        known = known.join(_key_sets(fingerprints, "lineage_id", column, name), "lineage_id", "left")
    asked = candidates.withColumn("_organizer", exact_key(F.col("organizer"))).join(_key_sets(candidates, "candidate_id", "event_labels", "_events"), "candidate_id", "left")
    judged = pairs.join(asked, "candidate_id").join(known, "lineage_id").withColumn("_why", rejection())
    fine = judged.where("_why IS NULL")
    best = fine.groupBy("lineage_id").agg(F.min("_rule").alias("_rule"))
    won = fine.join(best, ["lineage_id", "_rule"]).groupBy("lineage_id", "_rule").agg(F.min("candidate_id").alias("_c"), F.count(F.lit(1)).alias("_n"))
    basis = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("_rule") + 1)
    matches = won.select("lineage_id", F.when(F.col("_n") == 1, F.col("_c")).alias("candidate_id"), basis.alias("basis"), (F.col("_n") > 1).alias("ambiguous"))
    return matches, judged.where("_why IS NOT NULL").select("lineage_id", "candidate_id", F.col("_why").alias("reason")).distinct()
