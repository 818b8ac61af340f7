"""Writing results: JSON Lines by split, and all-or-nothing publication of a folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def json_line(df: DataFrame, nulls: bool = True) -> Column:
    """A row as one JSON object, keys in order; null fields are written as null, or with ``nulls=False`` left out."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": str(not nulls).lower()})


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", nulls: bool = True) -> None:
    """One JSON object a line (``json_line``)."""
    df.select(json_line(df, nulls).alias("value")).write.mode(mode).text(path)


def write_report(spark: SparkSession, path: str, value: dict) -> None:
    """A JSON file that replaces an older one at once: written beside it, then renamed over it."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, stage = _fs(spark, temporary)
    out = fs.create(stage, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True).encode() + b"\n"))
    finally:
        out.close()
    _, final = _fs(spark, path)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(stage.toUri(), spark._jsc.hadoopConfiguration())
        kinds = spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        context.rename(stage, final, kinds)
    except BaseException:
        fs.delete(stage, False)
        raise


def append_metrics(df: DataFrame, path: str) -> None:
    """Rows of metrics appended as JSON Lines, each with the time it was written."""
    append_jsonl(df.withColumn("written_at", F.current_timestamp()), path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appending needs no lock: every job commits files of its own."""
    write_jsonl(df, path, "append")


def publish(frames: Mapping[str, DataFrame], target: str, by_split: str | None = "records", need: tuple[str, ...] = ("train", "validation")) -> None:
    """Write ``frames`` as JSON Lines folders under ``target``, all or nothing.

    An existing target is an error. Everything goes to a staging folder beside it that is renamed at the end and deleted on any
    failure. The frame named ``by_split`` is partitioned by its metadata.split, and every split in ``need`` must have rows.
    """
    spark = SparkSession.active()
    fs, final = _fs(spark, target)
    if fs.exists(final):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}-staging-{uuid.uuid4().hex}"
    _, stage = _fs(spark, staging)
    try:
        for name, df in frames.items():
            if name == by_split:
                rows = df.select(json_line(df).alias("value"), F.col("metadata.split").alias("split"))
                rows.write.partitionBy("split").text(f"{staging}/{name}")
                for s in need:
                    if not exists(spark, f"{staging}/{name}/split={s}"):
                        raise ValueError(f"no rows for split {s}")
            else:
                write_jsonl(df, f"{staging}/{name}")
        if not fs.rename(stage, final):
            raise OSError(f"could not rename {staging}")
    except BaseException:
        fs.delete(stage, True)
        raise
