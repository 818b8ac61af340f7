"""Cutting lineage through reliable storage that every executor can reach."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The cluster names its shared folder in ``spark.checkpoint.dir``; only where that is unset and everything runs in one
    process (tests) is a folder of our own made. Executors on other machines could not read it, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix=f"sparkloom-{os.getpid()}-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return a DataFrame that reads it, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


#: Up to so many narrow rows are sent to the executors; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked to be sent to the executors if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= most else df
