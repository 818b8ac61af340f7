"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.overlap import held_coverage, overlaps


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/trajectories.parquet"), spark.read.parquet(f"{sf_dir}/resolved_sources.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and a held-out trajectory that agree in more than 80 of 100 words."""
    return _overlaps(spark, sf_dir).select(F.least("train_id", "held_id").alias("traj_a"), F.greatest("train_id", "held_id").alias("traj_b")).distinct()


def p1_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their similarity and the part of their words that chained seeds cover."""
    out = _overlaps(spark, sf_dir)
    return out.select("train_id", "train_source", "held_id", "held_source", "held_split", F.round("similarity", 6).alias("similarity"), F.round("covered", 6).alias("covered"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_coverage(spark.read.parquet(f"{sf_dir}/trajectories.parquet"), spark.read.parquet(f"{sf_dir}/resolved_sources.parquet"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out record that occurs in training: its training partners, similarity and the part of its words covered."""
    out = _coverage(spark, sf_dir)
    return out.select("held_id", "held_source", "held_split", "partners", *(F.round(c, 6).alias(c) for c in ("similarity", "best_similarity", "covered")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the held-out side: its records that occur in the training split, pairs, mean similarity and
    mean coverage of these records."""
    out = _coverage(spark, sf_dir).groupBy("held_split", "held_source").agg(
        F.sum("partners").alias("pairs"), F.count("*").alias("held_records"), F.round(F.sum(F.col("similarity") * F.col("partners")) / F.sum("partners"), 6).alias("mean_similarity"), F.round(F.avg("covered"), 6).alias("mean_coverage")
    )
    return out


QUERIES = {"p1_found": p1_found, "p1_overlaps": p1_overlaps, "p1_coverage": p1_coverage, "p1_report": p1_report}
SQL: dict[str, str] = {}
