"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import secrets


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.all_texts(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("tracked_files", "trajectories", "sources")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a usable secret."""
    found = secrets.scan_texts(_texts(spark, sf_dir), keep_text=False)
    return found.select("origin", "record_key", "pos", F.explode("lines").alias("line_no")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected text, masked: number of secrets, bytes and digest of the masked text."""
    found = secrets.scan_texts(_texts(spark, sf_dir))
    return found.select("origin", "record_key", "pos", "secrets", F.octet_length("redacted").cast("bigint").alias("bytes"), F.sha2("redacted", 256).alias("redacted_sha256")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per origin: affected texts, lines and masked literals."""
    found = secrets.scan_texts(_texts(spark, sf_dir), keep_text=False).select("origin", "record_key", "pos", "secrets", F.size("lines").alias("n")).distinct()
    return found.groupBy("origin").agg(F.count("*").alias("texts"), F.sum("n").alias("lines"), F.sum("secrets").alias("secrets"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted, "p3_report": p3_report}
SQL: dict[str, str] = {}
