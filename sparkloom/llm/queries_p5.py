"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.leakage import leaked_items


def _leaks(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_cases.parquet"), near=near)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least twelve words in a row of a case: windows of twelve words that match word for word."""
    return _leaks(spark, sf_dir, near=False).where("exact_windows > 0").select("doc_id", "case_id")


def p5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near or exact leaks, with the number of matching windows and the best similarity."""
    return _leaks(spark, sf_dir).select("doc_id", "case_id", "windows", "exact_windows", F.round("similarity", 6).alias("similarity"))


def p5_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case that leaked: documents affected, and documents holding a passage word for word."""
    return _leaks(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("documents"), F.count_if(F.col("exact_windows") > 0).alias("exact_documents"))


QUERIES = {"p5_found": p5_found, "p5_leaks": p5_leaks, "p5_cases": p5_cases}
SQL: dict[str, str] = {}
