"""Queries of the reading-level problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .readability import cross_validated, fit, reading_levels


def _model(spark: SparkSession, sf_dir: str):
    return fit(table(spark, sf_dir, "reading_anchors"), "text", "reading_level", "anchor_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars >= 600").select("doc_id", "text")
    return reading_levels(docs, "text", _model(spark, sf_dir)).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and level, over every English document."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text", "source", "n_chars")
    levels = reading_levels(docs, "text", _model(spark, sf_dir))
    return levels.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"), F.round(F.avg("median_estimate"), 4).alias("mean_estimate"))


def p9_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many held-out anchors each formula, and the median, places right: by the published coefficients and by refitted ones."""
    rows = cross_validated(table(spark, sf_dir, "reading_anchors"), "text", "reading_level", "anchor_id")
    return spark.createDataFrame(rows, "coefficients string, estimate string, anchors bigint, placed_right bigint")


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile, "p9_anchors": p9_anchors}
ORACLE: dict[str, str] = {}
