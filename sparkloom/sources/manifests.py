"""Manifests and data sets in JSON Lines, checked line by line; the first broken line is raised with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions import text as tx
from sparkloom.sources import jsonl

SOURCE_KEYS = ("authorized", "license_file", "license_spdx", "path", "source_id", "source_url")


def _kind(path: str) -> Column:
    """Type of a field, as the variant type names it (ARRAY<...>, OBJECT<...>, BOOLEAN, ...)."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), path, "variant"))


def _string(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("value"), path, "string")


def checked(lines: DataFrame, strict: bool, empty: str) -> DataFrame:
    """``lines``; with ``strict``, the first error by file and line is raised, and so is an empty input."""
    if strict:
        bad = lines.where("error IS NOT NULL").orderBy("file", "line").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].file}:{bad[0].line}: {bad[0].error}")
        if lines.isEmpty():
            raise ValueError(empty)
    return lines


def source_manifest(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(file, line, error, source_id, path, source_url, license_spdx, license_file, revision, authorized) of a manifest of sources.

    Only the JSON value true authorizes. The same source twice is an error at its second line; so are a missing key, an
    empty id or address, an unsafe license file and a revision that is not a full digest. An empty manifest is an error.
    """
    lines = jsonl.objects(jsonl.read_jsonl(spark, path), SOURCE_KEYS)
    row = lines.select(
        "file",
        "line",
        "error",
        tx.strip(_string("$.source_id")).alias("source_id"),
        _string("$.path").alias("path"),
        tx.strip(_string("$.source_url")).alias("source_url"),
        _string("$.license_spdx").alias("license_spdx"),
        _string("$.license_file").alias("license_file"),
        F.nullif(_string("$.revision"), F.lit("")).alias("revision"),
        F.coalesce((_kind("$.authorized") == "BOOLEAN") & F.try_variant_get(F.try_parse_json("value"), "$.authorized", "boolean"), F.lit(False)).alias("authorized"),
    )
    place = F.struct("file", "line")
    first = row.where("error IS NULL").groupBy("source_id").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    error = F.coalesce(
        "error",
        F.when(F.coalesce("source_id", F.lit("")) == "", "no source id"),
        F.when(F.col("_first") < place, "duplicate source id"),
        F.when(F.coalesce("source_url", F.lit("")) == "", "no source url"),
        F.when(F.col("license_file").isNull() | paths.is_unsafe("license_file"), "unsafe license file"),
        F.when(F.col("revision").isNotNull() & ~F.col("revision").rlike(r"\A[0-9a-f]{40}\z"), "revision is not a full digest"),
    )
    return checked(row.join(first, "source_id", "left").withColumn("error", error).drop("_first"), strict, "the source manifest is empty")


def chat_rows(spark: SparkSession, path: str | list[str], strict: bool = True, expected: bool = False) -> DataFrame:
    """(file, line, value, error) of records with a list of messages and, with ``expected``, an object of that name. Row access
    is a filter on file and line."""
    lines = jsonl.objects(jsonl.read_jsonl(spark, path))
    wrong = F.coalesce(
        "error",
        F.when(~F.coalesce(_kind("$.messages").startswith("ARRAY"), F.lit(False)), "no list of messages"),
        F.when(F.lit(expected) & ~F.coalesce(_kind("$.expected").startswith("OBJECT"), F.lit(False)), "no expected decision"),
    )
    return checked(lines.withColumn("error", wrong), strict, "the data set is empty")
