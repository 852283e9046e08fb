"""Best representative of each duplicate group by Bayesian fusion with copy detection.

Sources claim field values for groups. Source accuracies, the chance that a source copies another, and the values'
posteriors are estimated in turn: a claim votes with ln(n A / (1 - A)), A being its source's accuracy and n the number
of false values assumed; a vote that the first source with that value may have been copied from counts only by its
independent share; shared false values speak for copying, shared true ones hardly, differing ones against it.

Pairs of sources are formed along stars only: a claim is compared with the first claim of the same value and with the
first claim of its group's field, so the work is linear in the claims, however many rows one group holds.

``precedence`` is an order of trust that outranks the evidence (a prior without bounds). Where it is total the
posterior decides nothing; without it the value of the highest posterior is taken.

Cases: null and blank values claim nothing; a group without any value for a field gets null value, record and
posterior for it; a source's latest claim replaces its earlier ones, whose values (posterior null, if no other source
claims them) come behind every other value; rows of one record id count once (the smallest row); a null source is a source of its own; a null
instant counts as the latest; equal posteriors: the smaller value, then the smaller record id; null group keys are
equal to each other; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, small, store


@dataclass(frozen=True)
class Fusion:
    """Parameters of the model; rounds end early once no source's accuracy moves by more than the tolerance."""

    rounds: int = 5
    tolerance: float = 0.02
    false_values: int = 10
    first_accuracy: float = 0.8
    copy_share: float = 0.8
    copy_prior: float = 0.1
    smoothing: float = 4.0
    bounds: tuple[float, float] = field(default=(0.05, 0.99))


def _blank_to_null(c: str) -> Column:
    return F.when(F.col(c).cast("string").rlike(r"\S"), F.col(c).cast("string"))


def claims_of(records: DataFrame, group: list[str], record: str, source: str, instant: str, fields: list[str]) -> DataFrame:
    """One claim for every (group, field, source): the latest, then that of the smaller record id."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), _blank_to_null(f).alias("_val")) for f in fields]))
    rows = records.select(F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"),
                          F.coalesce(F.col(instant), F.lit(2**62)).alias("_t"), F.col(record).alias("_rid"), values.alias("_x"))
    rows = rows.select("_g", "_src", "_t", "_rid", "_x._f", "_x._val").where("_val IS NOT NULL")
    one = rows.groupBy("_g", "_f", "_src").agg(F.min_by(F.struct("_val", "_t", "_rid"), F.struct((-F.col("_t")).alias("n"), F.col("_rid").alias("r"))).alias("_x"))
    return one.select("_g", "_f", "_src", "_x._val", "_x._t")


def _starred(claims: DataFrame) -> DataFrame:
    """Adds who claimed this value first (_orig), and who claimed anything first (_lead, with _lead_val)."""
    early = F.struct("_t", "_src")
    first = claims.groupBy("_g", "_f", "_val").agg(F.min(early).alias("_x")).select("_g", "_f", "_val", F.col("_x._src").alias("_orig"))
    lead = claims.groupBy("_g", "_f").agg(F.min(F.struct("_t", "_src", "_val")).alias("_x"), F.count_distinct("_val").alias("_k")).select("_g", "_f", F.col("_x._src").alias("_lead"), F.col("_x._val").alias("_lead_val"), "_k")
    return claims.join(first, ["_g", "_f", "_val"]).join(lead, ["_g", "_f"])


def _posteriors(claims: DataFrame, accuracy: DataFrame | None, copies: DataFrame | None, m: Fusion) -> DataFrame:
    """(_g, _f, _val, _post): a softmax over the values claimed and the false values that nobody claimed."""
    voted = claims.join(accuracy, "_src", "left") if accuracy is not None else claims.withColumn("_acc", F.lit(m.first_accuracy))
    voted = voted.join(copies, ["_src", "_orig"], "left") if copies is not None else voted.withColumn("_dep", F.lit(0.0))
    independent = F.when(F.col("_src") == F.col("_orig"), 1.0).otherwise(1 - m.copy_share * F.coalesce("_dep", F.lit(0.0)))
    vote = F.log(m.false_values * F.col("_acc") / (1 - F.col("_acc"))) * independent
    cell = voted.groupBy("_g", "_f", "_val").agg(F.sum(vote).alias("_s"), F.first("_k").alias("_k"))
    top = cell.groupBy("_g", "_f").agg(F.max("_s").alias("_max"))
    cell = cell.join(top, ["_g", "_f"]).withColumn("_e", F.exp(F.col("_s") - F.col("_max")))
    unseen = F.greatest(F.lit(m.false_values + 1) - F.col("_k"), F.lit(0)) * F.exp(-F.col("_max"))
    total = cell.groupBy("_g", "_f").agg((F.sum("_e") + F.first(unseen)).alias("_z"))
    return cell.join(total, ["_g", "_f"]).select("_g", "_f", "_val", (F.col("_e") / F.col("_z")).alias("_post"))


def _accuracies(judged: DataFrame, m: Fusion) -> DataFrame:
    lo, hi = m.bounds
    mean = (F.sum("_post") + m.smoothing * m.first_accuracy) / (F.count(F.lit(1)) + m.smoothing)
    return judged.groupBy("_src").agg(F.least(F.greatest(mean, F.lit(lo)), F.lit(hi)).alias("_acc"))


def _copying(judged: DataFrame, accuracy: DataFrame, m: Fusion) -> DataFrame:
    """(_src, _orig, _dep): the chance that _src copies _orig."""
    same = judged.where("_src <> _orig").select("_src", "_orig", F.col("_post").alias("_kt"), (1 - F.col("_post")).alias("_kf"), F.lit(0.0).alias("_kd"))
    differ = judged.where("_src <> _lead AND _val <> _lead_val").select("_src", F.col("_lead").alias("_orig"), F.lit(0.0).alias("_kt"), F.lit(0.0).alias("_kf"), F.lit(1.0).alias("_kd"))
    pairs = same.unionByName(differ).groupBy("_src", "_orig").agg(*[F.sum(k).alias(k) for k in ("_kt", "_kf", "_kd")])
    a = accuracy.select("_src", F.col("_acc").alias("_a1"))
    b = accuracy.select(F.col("_src").alias("_orig"), F.col("_acc").alias("_a2"))
    pairs = pairs.join(a, "_src").join(b, "_orig")
    c, n = m.copy_share, m.false_values
    pt, pf = F.col("_a1") * F.col("_a2"), (1 - F.col("_a1")) * (1 - F.col("_a2")) / n
    pd = 1 - pt - pf
    ct, cf, cd = F.col("_a2") * c + pt * (1 - c), (1 - F.col("_a2")) * c + pf * (1 - c), pd * (1 - c)
    odds = F.log(F.lit(m.copy_prior / (1 - m.copy_prior))) + F.col("_kt") * F.log(ct / pt) + F.col("_kf") * F.log(cf / pf) + F.col("_kd") * F.log(cd / pd)
    return pairs.select("_src", "_orig", (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-50.0)), F.lit(50.0))))).alias("_dep"))


def value_posteriors(records: DataFrame, group: list[str], record: str, source: str, instant: str, fields: list[str], model: Fusion = Fusion()) -> tuple[Stored, Stored, Stored]:
    """Stored (_g, _f, _val, _post), source accuracies (_src, _acc) and copying (_src, _orig, _dep)."""
    claims = store(_starred(claims_of(records, group, record, source, instant, fields)), "fuse-claims")
    accuracy = copies = known = met = None  # known and met are the two with a hint for broadcast, if they are small
    for _ in range(max(model.rounds, 1)):
        post = _posteriors(claims.df, known, met, model)
        judged = store(claims.df.join(post, ["_g", "_f", "_val"]), "fuse-judged")
        old = accuracy, copies
        accuracy = store(_accuracies(judged.df, model), "fuse-accuracy")
        before, known = known, small(accuracy.df)
        copies = store(_copying(judged.df, known, model), "fuse-copies")
        met = small(copies.df)
        judged.drop()
        moved = _moved(before, known, model)
        for o in old:
            if o:
                o.drop()
        if moved <= model.tolerance:
            break
    final = store(_posteriors(claims.df, known, met, model), "fuse-posteriors")
    claims.drop()
    return final, accuracy, copies


def _moved(old: DataFrame | None, new: DataFrame, m: Fusion) -> float:
    """The largest change of a source's accuracy: one number."""
    before = old.select("_src", F.col("_acc").alias("_was")) if old is not None else new.select("_src", F.lit(m.first_accuracy).alias("_was"))
    return new.join(before, "_src").agg(F.max(F.abs(F.col("_acc") - F.col("_was")))).first()[0] or 0.0


def fuse(records: DataFrame, group: list[str], record: str, source: str, instant: str, fields: list[str], precedence: list[Column] | None = None, model: Fusion = Fusion()) -> DataFrame:
    """One row a group: the surviving record, and for each field its value, the record it is from and its posterior.

    precedence: columns of which the smaller is the better, compared before any evidence; for the survivor the mean
    posterior of a record's fields comes behind them.
    """
    whole = F.struct(*[F.col(c) for c in records.columns if c != record])
    rows = store(records.where(F.col(record).isNotNull()).groupBy(record).agg(F.min(whole).alias("_w")).select(record, "_w.*"), "fuse-records")
    post, *spent = value_posteriors(rows.df, group, record, source, instant, fields, model)
    for done in spent:
        done.drop()
    order = [p.alias(f"o{i}") for i, p in enumerate(precedence or [])]
    base = rows.df.select(F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g"), *[F.col(g) for g in group], F.col(record).alias("_rid"), F.struct(*order, F.lit(0).alias("z")).alias("_o"),
                          *[_blank_to_null(f).alias(f"_v{i}") for i, f in enumerate(fields)])
    for i, f in enumerate(fields):
        own = post.df.where(F.col("_f") == f).select("_g", F.col("_val").alias(f"_v{i}"), F.col("_post").alias(f"_p{i}"))
        base = base.join(own, ["_g", f"_v{i}"], "left")
    mean = sum((F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in range(len(fields))), F.lit(0.0)) / max(len(fields), 1)
    picks = [F.min(F.struct(F.col("_o"), (-mean).alias("m"), F.col("_rid").alias("r"))).alias("_best")]
    for i in range(len(fields)):
        p = F.col(f"_p{i}")  # null: the value's own source has replaced it
        seen = F.struct(F.col("_o"), p.isNull().alias("u"), (-p).alias("p"), F.col(f"_v{i}").alias("v"), F.col("_rid").alias("r"))
        picks.append(F.min(F.when(F.col(f"_v{i}").isNotNull(), seen)).alias(f"_f{i}"))
    out = base.groupBy("_g", *group).agg(*picks, F.count(F.lit(1)).alias("records"))
    columns = [F.col("_best.r").alias(f"surviving_{record}"), "records"]
    for i, f in enumerate(fields):
        columns += [F.col(f"_f{i}.v").alias(f), F.col(f"_f{i}.r").alias(f"{f}_from"), (-F.col(f"_f{i}.p")).alias(f"{f}_posterior")]
    return out.select(*group, *columns)
