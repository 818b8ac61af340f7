"""Evaluation analytics: scores of decisions, rates, gates, check roll-ups, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.jsonx import decision


def score(df: DataFrame, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """``df`` with valid, semantic, arguments_exact and error of each output against what was expected.

    An expected action asks for the same name (semantic) and equal arguments (exact); an expected result for any
    non-blank result. Plans are ignored.
    """
    both = df.withColumn("_a", decision(raw)).withColumn("_e", decision(expected))
    valid = F.col("_a.error").isNull()
    same = F.coalesce(F.col("_a.action_name") == F.col("_e.action_name"), F.lit(False))
    result = F.coalesce(F.regexp_replace("_a.result", r"(?U)\s+", "") != "", F.lit(False))
    wants_action = F.col("_e.action_name").isNotNull()
    semantic = valid & F.when(wants_action, same).otherwise(result)
    exact = semantic & F.when(wants_action, F.coalesce(F.col("_a.arguments") == F.col("_e.arguments"), F.lit(False))).otherwise(F.lit(True))
    return both.withColumn("valid", valid).withColumn("semantic", semantic).withColumn("arguments_exact", exact).withColumn("error", F.col("_a.error")).drop("_a", "_e")


def rates(scores: DataFrame, *by: str) -> DataFrame:
    """Cases and rates of valid, semantic and exact outputs for each group."""
    return scores.groupBy(*by).agg(F.count("*").alias("cases"), *(F.avg(F.col(c).cast("double")).alias(f"{n}_rate") for n, c in (("valid", "valid"), ("semantic", "semantic"), ("arguments_exact", "arguments_exact"))))


def gate(per_label: DataFrame, label: str, base: str, adapter: str, min_valid: float = 0.90, min_semantic: float = 0.80, tolerance: float = 0.05) -> DataFrame:
    """One row: whether the adapter's rates reach the thresholds and do not fall behind the base."""
    pick = lambda who, c: F.max(F.when(F.col(label) == who, F.col(c)))
    one = per_label.agg(pick(adapter, "valid_rate").alias("v"), pick(adapter, "semantic_rate").alias("s"), pick(base, "semantic_rate").alias("b"))
    ok = one.select((F.col("v") >= min_valid).alias("valid_ok"), (F.col("s") >= min_semantic).alias("semantic_ok"), (F.col("s") >= F.col("b") - tolerance).alias("not_worse"))
    return ok.withColumn("passed", F.coalesce(F.col("valid_ok") & F.col("semantic_ok") & F.col("not_worse"), F.lit(False)))


def check_passed(status: Column, conclusion: Column) -> Column:
    """With a conclusion the check must be completed and have succeeded or been skipped; without, its status says so."""
    good = ("success", "skipped")
    return F.coalesce(F.when(conclusion.isNotNull(), (status == "completed") & conclusion.isin(*good)).otherwise(status.isin(*good)), F.lit(False))


def all_passed(checks: DataFrame, passed: Column, *by: str) -> DataFrame:
    return checks.groupBy(*by).agg(F.count("*").alias("checks"), F.bool_and(passed).alias("all_passed"))


def pass_rate(results: DataFrame, *by: str) -> DataFrame:
    """Cases, passed ones and their share; a case passes when it completed and every check left with code 0."""
    passed = (F.col("runtime_status") == "completed") & F.forall("exit_codes", lambda c: c == 0)
    agg = (F.count("*").alias("cases"), F.count_if(F.coalesce(passed, F.lit(False))).alias("passed"))
    out = results.groupBy(*by).agg(*agg) if by else results.agg(*agg)
    return out.withColumn("pass_rate", F.try_divide("passed", "cases"))


def latest_checkpoint(paths: DataFrame, *by: str) -> DataFrame:
    """The checkpoint of the highest step among those with a state; names must end in the step."""
    step = F.regexp_extract("path", r"checkpoint-(\d+)\z", 1)
    good = paths.where("has_state").withColumn("_s", F.when(step != "", step.cast("bigint"))).where("_s IS NOT NULL")
    agg = F.max_by("path", "_s").alias("path"), F.max("_s").alias("step")
    return good.groupBy(*by).agg(*agg) if by else good.agg(*agg)


def prunable_checkpoints(paths: DataFrame, keep: int, *by: str) -> DataFrame:
    """All but the ``keep`` last checkpoints by name."""
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("path")))).where(F.col("_n") > keep).drop("_n")


def masked_mean(df: DataFrame, value: str, label: str, *by: str) -> DataFrame:
    """Mean of ``value`` where the label is not ignored, 0 if there is none."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(label) != -100, F.col(value))), F.lit(0.0)).alias("mean"))


def running_evidence(events: DataFrame, by: str, order: str, ok: Column) -> DataFrame:
    """``events`` with step (1, 2, ...) and ok_before: good observations of the same run before each."""
    w = Window.partitionBy(by).orderBy(order)
    return events.withColumn("step", F.row_number().over(w)).withColumn("ok_before", F.coalesce(F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def learning_rate(step: Column, peak: float, least: float, warmup: int, steps: int) -> Column:
    """Linear rise, then half a cosine down to ``least``."""
    rise = F.lit(peak) * (step + 1) / max(1, warmup)
    progress = F.least(F.greatest((step - warmup) / F.lit(float(max(1, steps - warmup))), F.lit(0.0)), F.lit(1.0))
    fall = F.lit(least) + (1 + F.cos(F.pi() * progress)) / 2 * (peak - least)
    return F.when(step < warmup, rise).otherwise(fall)


def parameter_count(hidden: Column, layers: Column, ffn: Column, heads: Column, kv_heads: Column, vocabulary: Column, tied: Column) -> Column:
    """Parameters of a decoder with grouped queries and gated feed-forward layers."""
    head = F.floor(hidden / heads)
    attention = hidden * heads * head + 2 * hidden * kv_heads * head + hidden * hidden
    tables = F.when(tied, 1).otherwise(2) * vocabulary * hidden
    return (tables + layers * (attention + 3 * hidden * ffn + 2 * hidden) + hidden).cast("bigint")
