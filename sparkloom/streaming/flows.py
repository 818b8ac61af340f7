"""Structured Streaming: windowed event counts, and the recorder of agent decisions as a stateful operator.

Streams read what is there and stop (``availableNow``); results are written by ``foreachBatch`` to the shared checkpoint
folder, never gathered in the driver, and read back as a DataFrame.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.functions.text import redact
from sparkloom.operators.lineage import ensure_checkpoint_dir


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a parquet folder, or over one parquet file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, name = posixpath.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over what is there. Append mode: all rows of all batches; complete mode: the last batch."""
    spark = stream.sparkSession
    home = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{home}/out/batch={last[-1]}")
    return spark.read.schema(stream.schema).option("basePath", f"{home}/out").parquet(*(f"{home}/out/batch={n}" for n in sorted(set(last)))).select(*stream.columns)


def windowed_events(events: DataFrame, late: str = "30 days", width: str = "1 hour") -> DataFrame:
    """Events and values by window and type; rows later than ``late`` are dropped in append mode."""
    by = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("events"), F.sum("value").alias("total"))


RECORDED = "run BIGINT, pos INT, plan STRING, decision STRING, error STRING"
STATE = "plan STRING, pos INT"


def recorder(events: DataFrame, most: int | None = 50_000) -> DataFrame:
    """Decisions of each run from a stream of (run, pos, kind, content), kind being plan, decision or other.

    Contents are cut to ``most`` characters (None: not at all) and redacted before they are held or recorded.

    A plan is held in state until the next event of its run, across batches: a decision takes it along, anything else is an
    error, and so is a second plan. Events of a run must arrive in order of pos; those at or before the last one seen are
    redeliveries and change nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plan, last = state.get if state.exists else (None, -1)
        out = []
        for row in pd.concat(batches).drop_duplicates("pos").sort_values("pos").itertuples():
            if row.pos <= last:
                continue
            last = int(row.pos)
            error = None
            if row.kind == "plan":
                if plan is None:
                    plan = row.content or ""
                    continue
                error = "two plans in a row"
            elif row.kind != "decision" and plan is not None:
                error = "plan without action or result"
            if row.kind == "decision" or error:
                out.append((key[0], last, plan, row.content, error))
                plan = None
        state.update((plan, last))
        yield pd.DataFrame(out, columns=["run", "pos", "plan", "decision", "error"])

    clean = events.select("run", "pos", "kind", redact("content", most=most).alias("content"))
    return clean.groupBy("run").applyInPandasWithState(fold, RECORDED, STATE, "append", GroupStateTimeout.NoTimeout)


def message_events(trajectories: DataFrame) -> DataFrame:
    """Conversations as events of runs for ``recorder``."""
    m = trajectories.select(F.col("traj_id").alias("run"), F.posexplode("messages").alias("pos", "m"))
    kind = F.when(F.col("m.role") != "assistant", "other").when(F.col("m.channel") == "plan", "plan").otherwise("decision")
    return m.select("run", "pos", F.coalesce(kind, F.lit("other")).alias("kind"), F.coalesce("m.decision", "m.action", "m.content").alias("content"))
