"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing
from sparkloom.operators.lineage import cut


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.token_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that cannot reach their share: the allocation clamps them at their cap below their target."""
    return mixing.mix_plan(*_tables(spark, sf_dir)).where("NOT reachable").select("source")


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation: passes over each feed and the shares reached."""
    return mixing.mix_plan(*_tables(spark, sf_dir)).select("source", "target_share", "max_repeats", "tokens", "reachable", F.round("repeats", 9).alias("repeats"), F.round("actual_share", 9).alias("actual_share"))


def p6_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn document with its copies."""
    sizes, targets = _tables(spark, sf_dir)
    sizes = cut(sizes)
    return mixing.draw(sizes, mixing.mix_plan(sizes, targets))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the documents as drawn, against the targets."""
    sizes, targets = _tables(spark, sf_dir)
    sizes = cut(sizes)
    plan = mixing.mix_plan(sizes, targets)
    drawn = mixing.draw(sizes, plan).groupBy("feed").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"))
    total = drawn.agg(F.sum("drawn_tokens").alias("all_tokens"))
    out = plan.join(drawn, "feed", "left").crossJoin(total)  # one row
    return out.select("source", "target_share", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)), 9).alias("drawn_share"))


QUERIES = {"p6_found": p6_found, "p6_mix": p6_mix, "p6_drawn": p6_drawn, "p6_shares": p6_shares}
SQL: dict[str, str] = {}
