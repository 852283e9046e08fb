"""Top N items of every group by simultaneous per-group bisection.

Every row gets an order-preserving code: its scores, turned so that smaller is better, then its identifier. All
groups refine their cutoffs at once: a round splits each open group's code interval at ``fanout - 1`` midpoints,
counts the rows between them (counts combine on the map side), accepts the leading intervals that fit, drops those
behind, and goes on inside the one interval that the cutoff lies in. Codes are unique in a group, so every group ends
at exactly N rows, or at all of them if it has fewer. No group is ever sorted or gathered in one task: what is
grouped or windowed per group is at most ``fanout`` counters.

Cases:

* scores are whole numbers, doubles (by the order of their bits) or decimals, compared exactly; other types are refused;
* a null score is below every number; a column that is null throughout decides nothing;
* rows with a null group or identifier name nothing to rank and are left out;
* several rows of one identifier in a group: the best of them counts, the others are dropped;
* equal scores: the smaller identifier in byte order comes first;
* an empty table gives an empty result; other columns of the input play no part, whatever they are called.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import small, store

#: Bytes of a code that one round looks at, behind the prefix that all codes of the interval share.
CHUNK = 6
FANOUT = 64


@F.pandas_udf(T.LongType())
def _double_code(s: pd.Series) -> pd.Series:
    """Doubles as whole numbers of the same order: the bits, turned round below zero; -0.0 is 0.0, NaN is above all."""
    x = s.to_numpy(dtype=np.float64) + 0.0  # no nulls come here
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(bits < 0, np.int64(-(2**63)) - bits, bits))


def _whole(df: DataFrame, c: str) -> Column:
    """A score as decimal(38,0) of the same order; TypeError for what is no number."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(c).cast("decimal(38,0)")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when(F.col(c).isNotNull(), _double_code(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).cast("decimal(38,0)")
    if isinstance(kind, T.DecimalType) and kind.precision + kind.scale + 2 <= 38:
        return (F.col(c) * F.lit(Decimal(10**kind.scale)).cast(f"decimal({kind.scale + 1},0)")).cast("decimal(38,0)")
    raise TypeError(f"{c}: {kind.simpleString()} cannot be ranked; give whole numbers, doubles or decimals with precision + scale of at most 36")


def _packed(df: DataFrame, scores: list[str]) -> tuple[Column, int, bool]:
    """The scores as one number (or, over 62 bits, as bytes): smaller is better. Widths follow from the data's range."""
    whole = [_whole(df, c) for c in scores]
    ends = df.agg(*[f(w).alias(f"{n}{i}") for i, w in enumerate(whole) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = []
    for i, w in enumerate(whole):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        spread = int(hi) - int(lo)
        worst = F.lit(Decimal(spread + 1)).cast("decimal(38,0)")
        parts.append((F.coalesce((F.lit(hi).cast("decimal(38,0)") - w).cast("decimal(38,0)"), worst), spread + 1))
    bits = sum(s.bit_length() for _, s in parts)
    if bits <= 62:
        value = reduce(lambda acc, p: F.shiftleft(acc, p[1].bit_length()) + p[0].cast("bigint"), parts, F.lit(0).cast("bigint"))
        return value, (bits + 7) // 8, True
    digits = [len(str(s)) for _, s in parts]
    return F.concat(*[F.encode(F.lpad(v.cast("string"), d, "0"), "UTF-8") for (v, _), d in zip(parts, digits)]), sum(digits), False


def _codes(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(_g, _id, _code): one row per item of a group, the best one."""
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    value, width, number = _packed(rows, scores)
    best = rows.select(F.col(group).alias("_g"), F.col(item).cast("string").alias("_id"), value.alias("_s")).groupBy("_g", "_id").agg(F.min("_s").alias("_s"))
    head = F.unhex(F.lpad(F.hex("_s"), 2 * width, "0")) if number and width else F.col("_s") if not number else F.unhex(F.lit(""))
    return best.select("_g", "_id", F.concat(head, F.encode("_id", "UTF-8")).alias("_code"))


def _chunk(code: str) -> str:
    """SQL: the next bytes behind the shared prefix as a number; the shorter of two codes that agree so far is smaller."""
    return f"(cast(conv(rpad(hex(substring({code}, _p + 1, {CHUNK})), {2 * CHUNK}, '0'), 16, 10) as bigint) * 8 + least(greatest(length({code}) - _p, 0), 7))"


def _interval(df: DataFrame) -> DataFrame:
    """Adds the shared prefix of _mn and _mx and both ends as numbers."""
    differs = "array_position(transform(sequence(1, greatest(length(_mn), length(_mx))), i -> substring(_mn, i, 1) <> substring(_mx, i, 1)), true)"
    df = df.withColumn("_p", F.expr(f"cast({differs} as int) - 1"))
    return df.withColumns({"_lo": F.expr(_chunk("_mn")), "_hi": F.expr(_chunk("_mx"))})


def top_n(df: DataFrame, group: str, item: str, scores: list[str], n: int, fanout: int = FANOUT) -> DataFrame:
    """(group, item, position) of the first n items of every group; position counts from 1."""
    codes = store(_codes(df, group, item, scores), "topn-codes")  # kept: the result is read from it
    base = codes.df
    start = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_mn"), F.max("_code").alias("_mx"))
    whole = F.col("_n") <= n
    state = store(start.select("_g", F.when(whole, F.col("_mx")).alias("_cut"), F.lit(n).cast("bigint").alias("_need"), F.when(whole, None).otherwise(F.col("_mn")).alias("_mn"), F.when(whole, None).otherwise(F.col("_mx")).alias("_mx"), "_n"), "topn-state")
    closed, active, size = [], codes, None  # every round's closed groups stay until the result is read
    while True:
        left = state.df.where("_mn IS NOT NULL")
        closed.append(state.df.where("_mn IS NULL").select("_g", "_cut"))
        open_groups, rows = left.agg(F.count(F.lit(1)), F.sum("_n")).first()
        if not open_groups:
            break
        inside = active.df.select("_g", "_code").join(small(_interval(left)), "_g").where("_code BETWEEN _mn AND _mx")
        if size is not None and rows * 2 < size:  # the open intervals have shrunk: later rounds read only these rows
            before, active = active, store(inside.select("_g", "_code"), "topn-active")
            if before is not codes:
                before.drop()
            inside = active.df.join(small(_interval(left)), "_g")
            size = rows
        size = size or rows
        at = F.expr(f"cast(({_chunk('_code')} - _lo) * {fanout} div (_hi - _lo + 1) as int)")
        counts = inside.withColumn("_b", at).groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_code").alias("_bmn"), F.max("_code").alias("_bmx"), F.first("_need").alias("_need"), F.first("_cut").alias("_old"))
        seen = F.sum("_c").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_cum", seen)
        fits, holds = F.col("_cum") <= F.col("_need"), (F.col("_cum") > F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need"))
        state = store(counts.groupBy("_g").agg(
            F.coalesce(F.max(F.when(fits, F.col("_bmx"))), F.first("_old")).alias("_cut"),
            (F.first("_need") - F.coalesce(F.max(F.when(fits, F.col("_cum"))), F.lit(0))).alias("_need"),
            F.max(F.when(holds, F.col("_bmn"))).alias("_mn"), F.max(F.when(holds, F.col("_bmx"))).alias("_mx"), F.max(F.when(holds, F.col("_c"))).alias("_n")), "topn-state")
    if active is not codes:
        active.drop()
    cuts = reduce(DataFrame.unionByName, closed)
    kept = base.join(small(cuts), "_g").where("_code <= _cut")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_code"))  # at most n rows a group are left
    return kept.select(F.col("_g").alias(group), F.col("_id").alias(item), place.cast("bigint").alias("position"))

