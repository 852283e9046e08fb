"""One mixture of several sources with target shares of all tokens.

The total is the largest that keeps every target share without any source passing its cap: the least, over the
sources, of tokens x max_repeats / share; a smaller total can be asked for. A source's budget is its share of that total;
as many complete epochs of the source as fit come first, and the rest is filled by a weighted sample without replacement
after Efraimidis and Spirakis: every document draws the key -ln(u) / weight from a hash of its id, and documents are
taken in the order of their keys while their summed tokens stay within the rest, the next one too if that comes closer
to it.

The keys are never sorted as a whole. They fall into ``BUCKETS`` buckets by a monotone function; the buckets' token
sums (combined on the map side) tell which buckets lie before the border, and only the border's bucket of each source
is ordered. The plan on the driver has one row a source that has a target.

Cases: a source without a target, a null source, and a target source without tokens give no rows, the last one does
not bind the total; equal keys go by the smaller id; a document without tokens costs nothing and is used like others;
rows of one id are one document (the smallest row by source, tokens and weight stands), rows without an id cannot be
named and are left out; a null or non-positive weight counts as the least weight; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stored, store

BUCKETS = 4096
LEAST_WEIGHT = 0.01


# Frequent English, Spanish and French function words; running text has many of them, lists have few.
FUNCTION_WORDS = frozenset("the of and to a in that is was for it with as on be at by i this had not are but from or have an they which you were her she he his we their there been has when who will more if no out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many de la que el en y los se del las un por con una su para es al lo como le les des est une du dans qui pour pas sur au plus ne par ce il".split())


def quality_of(text: str) -> float:
    """Weight of one text, 0.05 to 1: the geometric mean of five signals that tell running prose from lists and debris.

    Share of letters among visible characters; share of function words (a fifth is plenty); share of lines that end a
    sentence or go on; how many of the words differ, by Heaps' law (0.6 of the root-like growth expected is plenty); and
    how near the mean word length is to 3 to 9 letters.
    """
    words = text.split()
    if not words:
        return 0.05
    visible = sum(map(len, words))
    letters = sum(map(str.isalpha, text)) / visible
    bare = [w.strip(".,;:!?\"'()[]").lower() for w in words]
    function = min(sum(map(FUNCTION_WORDS.__contains__, bare)) / len(words) / 0.2, 1.0)
    lines = [line for line in text.splitlines() if line.strip()]
    ended = sum(line.rstrip()[-1] in ".!?:;,\"')”" or len(line) > 60 for line in lines) / len(lines)
    fresh = min(len(set(bare)) / (len(words) ** 0.8 * 0.6), 1.0)
    length = visible / len(words)
    usual = min(length / 3, 1.0, 9 / length)
    signals = (letters, 0.1 + 0.9 * function, 0.1 + 0.9 * ended, fresh, usual)
    return max(math.prod(max(x, 1e-6) for x in signals) ** (1 / len(signals)), 0.05)


def quality(texts: pa.Array) -> np.ndarray:
    """``quality_of`` every text of an Arrow array; null counts as empty."""
    return np.array([quality_of(t or "") for t in texts.to_pylist()], dtype=float)


@dataclass(frozen=True)
class SourcePlan:
    source: str
    share: float
    tokens: int
    budget: int
    epochs: int
    rest: int


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> list[SourcePlan]:
    """Budgets by exact fractions; targets are (source, share, max_repeats), one a source, else ValueError; total: at most so many tokens."""
    named = [t[0] for t in targets if t[0] is not None]
    if len(named) != len(set(named)):
        raise ValueError("a source has several targets")
    have = dict(totals)
    live = [(s, Fraction(p).limit_denominator(10**9), r) for s, p, r in targets if s is not None and p and p > 0 and r and r > 0 and have.get(s)]
    if not live:
        return []
    whole = min(Fraction(have[s] * r) / p for s, p, r in live)
    if total is not None:
        whole = min(whole, Fraction(total))
    out = []
    for s, p, r in live:
        budget = min(int(p * whole), have[s] * r)
        out.append(SourcePlan(s, float(p), have[s], budget, budget // have[s], budget % have[s]))
    return out


def mix(sized: Stored, key: str, source: str, tokens: str, weight: str, targets: list[tuple[str, float, int]], seed: int = 7, buckets: int = BUCKETS, total: int | None = None) -> tuple[DataFrame, list[SourcePlan]]:
    """((key, source, tokens, copies), plan): every document that is used, and how often."""
    spark = sized.df.sparkSession
    one = F.min(F.struct(F.col(source).alias("s"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"), F.col(weight).cast("double").alias("w")))
    once = store(sized.df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(one.alias("_x")).select("_key", F.col("_x.s").alias("_source"), F.col("_x.n").alias("_n"), F.col("_x.w").alias("_w")), "mix-documents").df
    totals = once.join(F.broadcast(spark.createDataFrame([(t[0],) for t in targets if t[0] is not None], "_source string")), "_source").groupBy("_source").agg(F.sum("_n")).collect()  # one row a target
    plans = plan([(r[0], int(r[1] or 0)) for r in totals], targets, total)
    rows = [(p.source, p.epochs, p.rest) for p in plans]
    wanted = F.broadcast(spark.createDataFrame(rows, "_source string, _epochs bigint, _rest bigint"))
    u = (F.pmod(F.xxhash64(F.col("_key"), F.lit(seed)), F.lit(2**52)).cast("double") + 1) / float(2**52 + 1)
    w = F.greatest(F.coalesce(F.col("_w"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    docs = once.select("_key", "_source", "_n", (-F.log(u) / w).alias("_k")).join(wanted, "_source")
    docs = docs.withColumn("_b", F.least(F.floor((1 - F.exp(-F.col("_k") / 2)) * buckets), F.lit(buckets - 1)).cast("int"))
    sums = docs.groupBy("_source", "_rest", "_b").agg(F.sum("_n").alias("_s"))
    upto = F.sum("_s").over(Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    border = sums.withColumn("_upto", upto).where("_upto > _rest").groupBy("_source").agg(F.min_by(F.struct(F.col("_b").alias("_at"), (F.col("_upto") - F.col("_s")).alias("_before")), "_b").alias("_x"))
    border = border.select("_source", "_x._at", "_x._before")
    placed = docs.join(F.broadcast(border), "_source", "left")  # one row a source that has a target
    run = F.sum("_n").over(Window.partitionBy("_source").orderBy("_k", "_key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    inside = placed.where("_b = _at AND _rest > 0").withColumn("_cum", run)
    taken = inside.where("_cum <= _rest OR (_cum - _rest < _rest - (_cum - _n) AND _cum - _n <= _rest)")
    extra = placed.where("_rest > 0 AND (_at IS NULL OR _b < _at)").select("_key", "_source", "_n").unionByName(taken.select("_key", "_source", "_n")).withColumn("_c", F.lit(1).cast("bigint"))
    whole = docs.where("_epochs > 0").select("_key", "_source", "_n", F.col("_epochs").alias("_c"))
    used = whole.unionByName(extra).groupBy("_key", "_source", "_n").agg(F.sum("_c").alias("copies"))
    return used.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_n").alias(tokens), "copies"), plans
