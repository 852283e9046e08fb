"""Integrity checks as DataFrames of offenders: Spark enforces no keys, so each constraint is a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_parents(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child rows with a non-null key that the parent lacks."""
    have = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)]).distinct()
    on = [child[k] == have[f"_p{i}"] for i, k in enumerate(keys)]
    return child.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).join(have, on, "left_anti")


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that a row breaks (a rule is what must hold; null counts as broken), else null."""
    out = F.lit(None).cast("string")
    for code, rule in reversed(rules):
        out = F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one with ``error_code``)."""
    marked = df.withColumn("error_code", first_failure(rules))
    return marked.where("error_code IS NULL").drop("error_code"), marked.where("error_code IS NOT NULL")


def exactly_one(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """left with ``value`` of the only right row of equal keys (null equals null); null where there is none or several."""
    by = [F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(keys)]
    one = right.groupBy(*by).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("matches"))
    joined = left.join(one, [left[a].eqNullSafe(one[f"_k{i}"]) for i, (a, _) in enumerate(keys)], "left")
    return joined.withColumns({"matches": F.coalesce("matches", F.lit(0)), value: F.when(F.col("matches") == 1, F.col(value))}).drop(*[f"_k{i}" for i in range(len(keys))])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` per key, as an aggregate that combines on the map side."""
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def full_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys that one side lacks or whose fields differ: status and the names of the differing fields."""
    x = a.select(*keys, F.struct(*fields).alias("_a"))
    y = b.select(*keys, F.struct(*fields).alias("_b"))
    both = x.join(y, keys, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size(differ) > 0, "differs")
    return both.select(*keys, status.alias("status"), F.when(status == "differs", differ).alias("fields")).where("status IS NOT NULL")


def digest_errors(contents: DataFrame, reviewed: DataFrame, key: str, content: str) -> DataFrame:
    """(key, error) of contents against reviewed (key, sha256, bytes): NOT_REVIEWED, DIGEST_MISMATCH, SIZE_MISMATCH or null."""
    met = contents.join(reviewed.select(key, F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes")), key, "left")
    rules = [("NOT_REVIEWED", F.col("_sha").isNotNull()), ("DIGEST_MISMATCH", F.sha2(F.col(content), 256) == F.col("_sha")), ("SIZE_MISMATCH", F.octet_length(F.col(content)) == F.col("_bytes"))]
    return met.select(key, first_failure(rules).alias("error"))
