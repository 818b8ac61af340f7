"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import licenses
from sparkloom.operators.lineage import cut


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, sources = spark.read.parquet(f"{sf_dir}/tracked_files.parquet"), spark.read.parquet(f"{sf_dir}/sources.parquet")
    statements = cut(licenses.file_statements(files))
    return statements, cut(licenses.repository_licenses(sources, statements, licenses.texts_named_elsewhere(files, sources)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories (empty path) and regular files whose license is contradictory or unknown: files by what they state
    themselves against their repository, so a license file above an otherwise silent file does not count here."""
    statements, repositories = _parts(spark, sf_dir)
    files = licenses.effective_licenses(statements, repositories)
    rows = repositories.select("source_id", F.lit("").alias("path"), "verdict").union(files.select("source_id", "path", "verdict"))
    return rows.where("verdict <> 'known'").distinct()


def p4_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of each repository, by its listing and by its license file, and whether it is authorized."""
    _, repositories = _parts(spark, sf_dir)
    return repositories.select("source_id", "authorized", F.array_join("declared", ",").alias("declared"), "expression", F.array_join("in_file", ",").alias("in_file"), F.array_join("licenses", ",").alias("licenses"), "verdict")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that applies to each regular file and where it comes from."""
    rows = licenses.effective_licenses(*_parts(spark, sf_dir))
    return rows.select("source_id", "path", F.array_join("licenses", ",").alias("licenses"), "origin", "from_path", "verdict", "nearest_verdict", "authorized")


QUERIES = {"p4_found": p4_found, "p4_repositories": p4_repositories, "p4_files": p4_files}
SQL: dict[str, str] = {}
