"""Reading the tables of a folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.corpus import latest_wide


#: Folder of public vocabulary files.
TOKENIZER_DIR = os.environ.get("SPARKLOOM_TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of more bytes are never moved to more tasks; files of a table that large split well enough.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where small files give fewer tasks than there are (a file that cannot be split starves them)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = 0
    for name in df.inputFiles():  # fewer than there are cores, or about that
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size > SPREAD_BYTES:
            return df
    return df.repartition(cores)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scan of every tracked file."""
    return latest_wide(spread(table(spark, sf_dir, "tracked_files")), ["source_id", "path"], "scanned_at")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trajectory."""
    return latest_wide(spread(table(spark, sf_dir, "trajectories")), ["traj_id"], "recorded_at").select("traj_id", "source_id", "messages", "metadata")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"))
