"""Streams over the tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import RECORDED_SECRETS
from sparkloom.plans.analytics_queries import SQL as BATCH
from sparkloom.plans.trajectory_queries import _M
from sparkloom.streaming import flows


def streamed_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as event_windows, as a stream."""
    out = flows.run_available(flows.windowed_events(flows.stream_of(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of every conversation with the plans that the recorder held for them."""
    out = flows.run_available(flows.recorder(flows.message_events(flows.stream_of(spark, f"{sf_dir}/trajectories.parquet"))))
    return out.select(F.col("run").alias("traj_id"), F.col("pos").cast("bigint").alias("pos"), "plan", "decision", "error")


def _redacted(x: str) -> str:
    return "regexp_replace(" * len(RECORDED_SECRETS) + f"({x})[1:50000]" + "".join(f", '{p}', '<REDACTED>', 'g')" for p in RECORDED_SECRETS)


QUERIES = {f.__name__: f for f in (streamed_event_windows, streamed_decisions)}
SQL = {
    "streamed_event_windows": BATCH["event_windows"],
    "streamed_decisions": f"""WITH {_M}, k AS (SELECT traj_id, i, CASE WHEN m.role <> 'assistant' THEN 'other' WHEN m.channel = 'plan' THEN 'plan' WHEN m.role = 'assistant' THEN 'decision' ELSE 'other' END AS kind, m FROM m),
l AS (SELECT *, lag(kind) OVER w AS before, lag(m.content) OVER w AS plan FROM k WINDOW w AS (PARTITION BY traj_id ORDER BY i))
SELECT traj_id, i AS pos, CASE WHEN before = 'plan' THEN {_redacted("coalesce(plan, '')")} END AS plan, {_redacted('coalesce(m.decision, m.action, m.content)')} AS decision, NULL::VARCHAR AS error FROM l WHERE kind = 'decision'""",
}
