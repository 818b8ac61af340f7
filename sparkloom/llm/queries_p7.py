"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import canonical


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.lookalike_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the length and digest of its canonical text and whether that differs from the stored one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = canonical.with_canonical(docs)
    return out.select("doc_id", F.length("canonical_text").cast("bigint").alias("canonical_chars"), F.sha2("canonical_text", 256).alias("canonical_sha256"), (~F.col("canonical_text").eqNullSafe(F.col("text"))).alias("changed"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "class_id", "texts", "documents")


QUERIES = {"p7_found": p7_found, "p7_canonical": p7_canonical, "p7_classes": p7_classes}
SQL: dict[str, str] = {}
