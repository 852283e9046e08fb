"""The provider's nested JSON export: read with a closed schema, flattened, joined and normalized as DataFrames.

Ids may be numbers or strings and are read as strings; unknown keys are tolerated; one malformed required field fails
the whole read. Each error is a row of an errors table, not an exception, except where the export cannot be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.scoring import NATIONAL_POINTS, STAGES
from ..runtime import small

_s = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _list(item: T.DataType) -> T.ArrayType:
    return T.ArrayType(item)


_RESULT = _struct(entry=_s, place=_s, round=_s)
_SET = _struct(label=_s, tag=_s, bracket=_s, published=_s, generated=_s, results=_list(_RESULT))
_BALLOT = _struct(entry=_s, scores=_list(_struct(tag=_s, value=T.LongType())))
_ROUND = _struct(id=_s, label=_s, type=_s, sections=_list(_struct(id=_s, round=_s, ballots=_list(_BALLOT))))
_EVENT = _struct(id=_s, name=_s, rounds=_list(_ROUND), result_sets=_list(_SET))
EXPORT = _struct(
    id=_s, categories=_list(_struct(id=_s, events=_list(_EVENT))),
    schools=_list(_struct(id=_s, name=_s, entries=_list(_struct(id=_s, event=_s, students=_list(_s), name=_s)), students=_list(_struct(id=_s, first=_s, last=_s)))),
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; a file that is no such JSON fails the read."""
    return spark.read.schema(EXPORT).option("multiLine", True).option("primitivesAsString", True).option("mode", "FAILFAST").json(path)


def parse_exports(df: DataFrame, column: str) -> DataFrame:
    """The same from a text column, so many exports in one table are parsed in parallel."""
    return df.withColumn("_e", F.from_json(column, EXPORT, {"mode": "FAILFAST", "primitivesAsString": "true"})).select(*[c for c in df.columns if c != column], "_e.*")


def entries(export: DataFrame) -> DataFrame:
    """entry_id, event_id, person_id (the first student), name, school."""
    s = export.select(F.explode("schools").alias("s"))
    known = F.transform("s.students", lambda x: x.id)
    e = s.select(F.col("s.id").alias("school_id"), F.col("s.name").alias("school"), known.alias("known"), F.explode("s.entries").alias("e"))
    first = F.try_element_at("e.students", F.lit(1))
    return e.select(F.col("e.id").alias("entry_id"), F.col("e.event").alias("event_id"), first.alias("person_id"), F.col("e.name").alias("name"), "school", F.array_contains("known", first).alias("person_known"))


def events(export: DataFrame) -> DataFrame:
    c = export.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.explode("c.events").alias("e"))
    return c.select("category_id", F.col("e.id").alias("event_id"), F.col("e.name").alias("event_name"), F.col("e.rounds").alias("rounds"), F.col("e.result_sets").alias("result_sets"))


def is_published(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))


def explicit_final(published: Column, tag: Column, bracket: Column) -> Column:
    fine = lambda c, *words: F.coalesce(F.lower(F.trim(c)).isin(*words), F.lit(False))
    return is_published(published) & fine(tag, "final", "cumulative") & fine(bracket, "0", "final", "cumulative")


def participation(events_df: DataFrame) -> DataFrame:
    """(event_id, round_id, stage, entry_id) of every ballot, once."""
    r = events_df.select("event_id", F.explode("rounds").alias("r"))
    stage = F.coalesce(text.round_stage(F.col("r.label")), text.round_stage(F.col("r.type")))
    b = r.select("event_id", F.col("r.id").alias("round_id"), stage.alias("stage"), F.explode("r.sections").alias("s")).select("event_id", "round_id", "stage", F.explode("s.ballots").alias("b"))
    return b.select("event_id", "round_id", "stage", F.col("b.entry").alias("entry_id")).distinct()


def rounds(events_df: DataFrame) -> DataFrame:
    r = events_df.select("event_id", F.explode("rounds").alias("r"))
    return r.select("event_id", F.col("r.id").alias("round_id"), F.coalesce(text.round_stage(F.col("r.label")), text.round_stage(F.col("r.type"))).alias("round_stage"))


def _depth(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int")


def normalize(export: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors). rules: category_id, event_id, lineage_id, division, labels (array of allowed set labels).

    A result's stage is that of its round if it names one, else the deepest round it took part in. Preliminary rows,
    and numbers beyond the largest elimination round, are dropped; other rows without a stage are diagnosed.
    """
    ev = events(export).join(small(rules), ["category_id", "event_id"])
    en = entries(export)
    sets = ev.select("event_id", "event_name", "lineage_id", "division", "labels", F.posexplode("result_sets").alias("set_no", "s"))
    sets = sets.where(is_published(F.col("s.published")) & F.array_contains("labels", F.col("s.label")))
    rows = sets.select("event_id", "event_name", "lineage_id", "division", "set_no", F.col("s.label").alias("label"), explicit_final(F.col("s.published"), F.col("s.tag"), F.col("s.bracket")).alias("explicit_final"), F.explode("s.results").alias("r"))
    rows = rows.select("*", F.col("r.entry").alias("entry_id"), F.col("r.place").alias("place"), F.col("r.round").alias("round_id")).drop("r")
    joined = rows.join(en.withColumnRenamed("event_id", "entry_event"), "entry_id", "left").join(rounds(ev), ["event_id", "round_id"], "left")
    took = participation(ev)
    deepest = took.groupBy("event_id", "entry_id").agg(F.max(_depth(F.col("stage"))).alias("_d"))
    largest = took.where("stage IS NOT NULL").groupBy("event_id", "round_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("event_id").agg(F.max("_n").alias("largest"))
    joined = joined.join(deepest, ["event_id", "entry_id"], "left").join(largest, "event_id", "left")
    by_part = F.try_element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("_d"))
    joined = joined.withColumn("stage", F.when(F.col("round_id").isNull(), by_part).otherwise(F.col("round_stage")))
    number = text.numeric_placement(F.col("place"))
    beyond = F.coalesce(number > F.col("largest"), F.lit(False)) & F.col("stage").isNull()
    kept = joined.where(~F.coalesce(text.is_preliminary(F.col("place")), F.lit(False)) & ~beyond)
    national = (F.col("lineage_id") == "nsda-nationals") & (number > len(NATIONAL_POINTS))
    kept = kept.withColumn("placement", F.when(~F.coalesce(national, F.lit(False)), number))
    code = (
        F.when(F.col("entry_event").isNull(), "MISSING_ENTRY").when(F.col("entry_event") != F.col("event_id"), "ENTRY_EVENT_MISMATCH").when(~F.coalesce("person_known", F.lit(False)), "MISSING_PERSON")
        .when(F.col("stage").isNull(), "UNKNOWN_ROUND_LABEL").when(text.placement_error(F.col("place"), F.col("stage") != "final").isNotNull(), "INVALID_PLACEMENT")
    )
    kept = kept.withColumn("code", code)
    good = kept.where("code IS NULL")
    errors = [kept.where("code IS NOT NULL").select("event_id", "set_no", "entry_id", "code")]
    for cols, name in ((["entry_id"], "DUPLICATE_RESULT_ENTRY"), (["placement"], "DUPLICATE_PLACEMENT")):
        twice = good.where(F.col(cols[0]).isNotNull()).groupBy("event_id", "set_no", *cols).agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("_e")).where("n > 1")
        errors.append(twice.select("event_id", "set_no", F.col("_e").alias("entry_id"), F.lit(name).alias("code")))
    out = good.select(
        "event_id", "event_name", "lineage_id", "division", "set_no", "explicit_final", F.concat(F.lit("provider:entry:"), "entry_id").alias("source_entry_id"), F.concat(F.lit("provider:person:"), "person_id").alias("source_person_key"),
        F.col("name").alias("published_name"), F.col("school").alias("published_school"), "placement", F.col("stage").alias("furthest_stage"), F.coalesce((F.col("placement") == 1) & (F.col("stage") == "final"), F.lit(False)).alias("won_final_round"))
    return out, reduce(DataFrame.unionByName, errors)


def duplicate_ids(export: DataFrame) -> DataFrame:
    """(kind, id) of every id of the export that occurs more than once."""
    ev = events(export)
    kinds = {
        "category": export.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("id")), "event": ev.select(F.col("event_id").alias("id")), "round": ev.select(F.explode("rounds").alias("r")).select(F.col("r.id").alias("id")),
        "school": export.select(F.explode("schools").alias("s")).select(F.col("s.id").alias("id")), "entry": entries(export).select(F.col("entry_id").alias("id")),
        "person": export.select(F.explode("schools").alias("s")).select(F.explode("s.students").alias("p")).select(F.col("p.id").alias("id")),
    }
    return reduce(DataFrame.unionByName, [d.groupBy("id").count().where("count > 1").select(F.lit(k).alias("kind"), "id") for k, d in kinds.items()])


def compact(export: DataFrame, eligible: Column) -> DataFrame:
    """Schools pruned to entries and students that eligible events refer to; ``eligible`` is a condition on event_name."""
    keep = events(export).where(eligible).select("event_id")
    en = entries(export)
    return en.join(keep, "event_id", "left_semi").select("entry_id", "event_id", "person_id", "name", "school")


def final_winners(export: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, errors) of the final round's ranked ballots: the only least rank sum, all entries ranked equally often."""
    r = events(export).select("event_id", F.explode("rounds").alias("r"))
    finals = r.where((F.lower(F.trim("r.type")) == "final") | (text.event_key(F.col("r.label")) == "final"))
    several = finals.groupBy("event_id").agg(F.count_distinct("r.id").alias("n")).where("n > 1").select("event_id", F.lit("SEVERAL_FINALS").alias("code"))
    ballots = finals.select("event_id", F.explode("r.sections").alias("s")).select("event_id", F.explode("s.ballots").alias("b"))
    ranks = F.filter(F.coalesce("b.scores", F.array().cast("array<struct<tag:string,value:bigint>>")), lambda x: F.lower(F.trim(x.tag)) == "rank")
    ballots = ballots.select("event_id", F.col("b.entry").alias("entry_id"), ranks.alias("ranks")).where(F.size("ranks") > 0)
    clash = ballots.where(F.size("ranks") > 1).select("event_id", F.lit("CONFLICTING_RANKS").alias("code")).distinct()
    totals = ballots.groupBy("event_id", "entry_id").agg(F.sum(F.try_element_at("ranks", F.lit(1)).value).alias("total"), F.count(F.lit(1)).alias("ballots"))
    best = totals.groupBy("event_id").agg(F.min("total").alias("total"), F.min("ballots").alias("_lo"), F.max("ballots").alias("_hi"))
    uneven = best.where("_lo <> _hi").select("event_id", F.lit("UNEQUAL_BALLOTS").alias("code"))
    firsts = totals.join(best, ["event_id", "total"]).groupBy("event_id", "total").agg(F.min("entry_id").alias("entry_id"), F.count(F.lit(1)).alias("n"))
    tied = firsts.where("n > 1").select("event_id", F.lit("TIED_FINAL").alias("code"))
    errors = reduce(DataFrame.unionByName, [several, clash, uneven, tied]).distinct()
    return firsts.where("n = 1").join(errors.select("event_id"), "event_id", "left_anti").select("event_id", "entry_id", "total"), errors
