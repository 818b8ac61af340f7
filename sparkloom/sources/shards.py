"""Packed shards on disk: parquet for Spark, flat little-endian files for training jobs, and their list."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MAX_ID = 65_535


def _packed(ids) -> bytes:
    a = np.asarray(ids, np.int64)
    if len(a) and (a.min() < 0 or a.max() > MAX_ID):
        raise ValueError(f"an id is not from 0 to {MAX_ID}")
    return a.astype("<u2").tobytes()


@F.pandas_udf(BinaryType())
def as_uint16(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Token ids as little-endian 16-bit numbers; larger ids are an error."""
    for s in batches:
        yield s.map(_packed)


@F.pandas_udf(BinaryType())
def as_uint8(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda m: bytes(int(x != 0) for x in m))


def write_shards(packed: DataFrame, path: str) -> DataFrame:
    """Write shards (shard, tokens, mask), one folder each, and return their list (shard, token_count, supervised)."""
    packed.select("shard", as_uint16("tokens").alias("tokens"), as_uint8("mask").alias("mask"), F.size("tokens").alias("token_count"), F.aggregate("mask", F.lit(0), lambda s, m: s + m.cast("int")).alias("supervised")).write.mode("errorifexists").partitionBy("shard").parquet(path)
    return list_shards(packed.sparkSession, path)


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder, without reading their tokens; a folder without any is an error."""
    out = spark.read.parquet(path).select("shard", "token_count", "supervised")
    if out.isEmpty():
        raise ValueError(f"no shards in {path}")
    return out


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, tokens, mask) as arrays again."""
    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, "<u2").astype(np.int32))

    @F.pandas_udf("array<int>")
    def flags(s: pd.Series) -> pd.Series:
        return s.map(list)

    return spark.read.parquet(path).select("shard", ids("tokens").alias("tokens"), flags("mask").alias("mask"))


def metadata(shards: DataFrame, vocabulary_size: int, **more) -> str:
    """Totals of the shards as JSON. The list of shards stays a table (``list_shards``); only its sums reach the driver."""
    if vocabulary_size > MAX_ID + 1:
        raise ValueError("the vocabulary does not fit 16-bit shards")
    one = shards.agg(F.count("*").alias("shards"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("supervised"), F.lit(0)).alias("supervised_tokens")).first()
    return json.dumps({**more, "format_version": 1, "token_dtype": "uint16", "mask_dtype": "uint8", "vocabulary_size": vocabulary_size, **one.asDict()}, sort_keys=True)
