"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import grouping
from sparkloom.operators.lineage import cut


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked groups that the present splits separate."""
    sources, contributors, resolved = _tables(spark, sf_dir, "sources", "contributors", "resolved_sources")
    groups = cut(grouping.linked_groups(sources, contributors, resolved))
    return grouping.separated_groups(groups, resolved)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every source."""
    return grouping.safe_splits(*_tables(spark, sf_dir, "sources", "contributors", "resolved_sources", "trajectories"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and trajectories of each new split."""
    trajectories = _tables(spark, sf_dir, "trajectories")[0]
    split = p2_splits(spark, sf_dir)
    n = trajectories.where("source_id IS NOT NULL AND traj_id IS NOT NULL").select("source_id", "traj_id").distinct().groupBy("source_id").agg(F.count("*").alias("n"))
    out = split.join(n, "source_id", "left").groupBy("split").agg(F.count("*").alias("sources"), F.sum(F.coalesce("n", F.lit(0))).alias("trajectories"))
    total = out.agg(F.sum("trajectories").alias("total"))
    return out.crossJoin(total).select("split", "sources", "trajectories", F.round(F.try_divide("trajectories", "total"), 9).alias("share"))  # one row


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares}
SQL = {
    "p2_found": r"""WITH RECURSIVE ids AS (SELECT source_id FROM sources UNION SELECT source_id FROM contributors UNION SELECT source_id FROM resolved_sources),
u AS (SELECT source_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://', ''), '^[^/@]*@', ''), '^([^/:]+):\d+(/|$)', '\1\2'), '^([^/:]+):', '\1/') AS u FROM sources),
k AS (SELECT source_id, 'o:' || lower(string_split(source_id, '/')[1]) AS k FROM ids WHERE source_id IS NOT NULL UNION SELECT source_id, 'r:' || regexp_replace(u, '(/|\.git)+$', '') FROM u WHERE u <> ''
  UNION SELECT source_id, 'a:' || lower(regexp_extract(author, '[^\s<>"(),;:]+@[^\s<>"(),;:]+')) FROM contributors WHERE regexp_matches(author, '[^\s<>"(),;:]+@[^\s<>"(),;:]+')),
e AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM k a JOIN k b USING (k)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
g AS (SELECT b AS source_id, min(a) AS group_head FROM reach GROUP BY b),
s AS (SELECT DISTINCT source_id, lower(trim(split)) AS split FROM resolved_sources WHERE trim(split) <> ''),
torn AS (SELECT group_head FROM g JOIN s USING (source_id) GROUP BY group_head HAVING count(DISTINCT split) > 1)
SELECT group_head, source_id FROM g WHERE group_head IN (SELECT group_head FROM torn)""",
}
