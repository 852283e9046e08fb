"""Queries of the packing and mixing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Stored, store, table
from .mixing import SourcePlan, mix, quality
from .packing import Fit, pack
from .tokens import VOCABULARY, with_token_counts


#: Most rows of pack_sizes and of mix_targets, which are read to the driver.
MAX_PACKS, MAX_TARGETS = 64, 100_000


def _sized(spark: SparkSession, sf_dir: str, vocabulary: str, weighted: bool) -> Stored:
    """Every document with its number of tokens (and weight), counted once and written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return store(with_token_counts(docs, "text", "n_tokens", vocabulary, {"weight": quality} if weighted else None), "sized")


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str) -> tuple[DataFrame, list[Fit]]:
    capacities = [(r[0], r[1]) for r in table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("pack_id").limit(MAX_PACKS + 1).collect()]
    if len(capacities) > MAX_PACKS:
        raise ValueError(f"at most {MAX_PACKS} pack sizes at once")
    return pack(_sized(spark, sf_dir, vocabulary, False).df, "doc_id", "n_tokens", capacities)


def p7_pack(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return _packed(spark, sf_dir, vocabulary)[0]


def p7_fill(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each pack: containers, items, tokens, the share of all space that they fill, and the share of the tokens that a pattern placed."""
    packed, fits = _packed(spark, sf_dir, vocabulary)
    each = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    asked = spark.createDataFrame([(f.pack_id, f.capacity, round(f.pattern_tokens / max(f.tokens, 1), 6)) for f in fits], "pack_id bigint, capacity bigint, by_patterns double")
    out = each.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).join(F.broadcast(asked), "pack_id")  # at most MAX_PACKS rows
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def _mixture(spark: SparkSession, sf_dir: str, vocabulary: str) -> tuple[DataFrame, list[SourcePlan]]:
    targets = [(r[0], r[1], r[2]) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").distinct().orderBy("source").limit(MAX_TARGETS + 1).collect()]
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} sources with a target")
    return mix(_sized(spark, sf_dir, vocabulary, True), "doc_id", "source", "n_tokens", "weight", targets)


def p8_mix(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return _mixture(spark, sf_dir, vocabulary)[0]


def p8_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each source: target and actual share of the mixture's tokens, documents used and the most copies of one."""
    used, plans = _mixture(spark, sf_dir, vocabulary)
    rows = [(p.source, p.share, p.tokens, p.budget, p.epochs) for p in plans]
    asked = spark.createDataFrame(rows, "source string, target_share double, source_tokens bigint, budget_tokens bigint, full_epochs bigint")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = F.sum("used_tokens").over(Window.partitionBy())  # one row a source that has a target
    return got.join(F.broadcast(asked), "source").withColumn("actual_share", F.round(F.col("used_tokens") / whole, 6))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
