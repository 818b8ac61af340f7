"""JSON Lines with places: every line keeps its file and number, however the file was split for reading."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROWS = "file STRING, block BIGINT, nth BIGINT, value STRING, error STRING, blank BOOLEAN"


def _object_error(line: str) -> str | None:
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return "not json"
    return None if isinstance(value, dict) else "not an object"


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value, error) of all non-blank lines; error is null for JSON objects.

    Lines are counted within each block of each file, and blocks are put one after the other by their sums, so files of any
    size are read in parallel.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            values, nth, errors, blank = b.column(0).to_pylist(), [], [], []
            for v, f, s in zip(values, b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen[f, s] = seen.get((f, s), 0) + 1
                nth.append(seen[f, s])
                blank.append(not v.strip())
                errors.append(None if blank[-1] else _object_error(v))
            cols = [b.column(1), b.column(2), pa.array(nth, pa.int64()), b.column(0), pa.array(errors, pa.string()), pa.array(blank, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["file", "block", "nth", "value", "error", "blank"])

    rows = text.mapInArrow(number, _ROWS)
    size = rows.groupBy("file", "block").agg(F.max("nth").alias("n"))
    before = size.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    return rows.join(before, ["file", "block"]).where("NOT blank").select("file", (F.col("before") + F.col("nth")).alias("line"), "value", "error")


def objects(lines: DataFrame, required: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``lines`` with error also for missing keys; with ``strict``, the first error (by file and line) is raised."""
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, sorted(required))), keys) if required else F.array().cast("array<string>")
    out = lines.withColumn("error", F.coalesce("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))))
    if strict and (bad := out.where("error IS NOT NULL").orderBy("file", "line").first()):
        raise ValueError(f"{bad.file}:{bad.line}: {bad.error}")
    return out


def in_order(frames: list[DataFrame]) -> DataFrame:
    """All inputs after one another, with their ordinal."""
    first, *rest = [f.withColumn("input", F.lit(i)) for i, f in enumerate(frames)]
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first
