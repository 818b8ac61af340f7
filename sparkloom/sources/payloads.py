"""Rows of changes and checks from the JSON answers of code hosts. The payload column holds JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.jsonx import parse_decision
from sparkloom.operators.lineage import sized

# Where each kind of host keeps a field.
CHANGE_PATHS = {
    "github": {"number": "$.number", "url": "$.html_url", "state": "$.state", "title": "$.title", "head_sha": "$.head.sha", "base_branch": "$.base.ref"},
    "gitlab": {"number": "$.iid", "url": "$.web_url", "state": "$.state", "title": "$.title", "head_sha": "$.sha", "base_branch": "$.target_branch"},
}
CHANGE_PATHS["gitea"] = CHANGE_PATHS["forgejo"] = CHANGE_PATHS["github"]
CHECK_LISTS = {
    "github": ("$.check_runs", {"name": "$.name", "status": "$.status", "conclusion": "$.conclusion", "url": "$.html_url"}),
    "gitlab": ("$", {"name": "$.name", "status": "$.status", "url": "$.target_url"}),
    "gitea": ("$", {"name": "$.context", "status": "$.status", "url": "$.target_url"}),
}
CHECK_LISTS["forgejo"] = CHECK_LISTS["gitea"]


def _variant(payload: str | Column) -> Column:
    return F.try_parse_json(payload)


def changes(df: DataFrame, dialect: str, payload: str = "payload") -> DataFrame:
    v = _variant(payload)
    return df.select(*(F.try_variant_get(v, p, "bigint" if n == "number" else "string").alias(n) for n, p in CHANGE_PATHS[dialect].items()))


def checks(df: DataFrame, dialect: str, payload: str = "payload") -> DataFrame:
    where, fields = CHECK_LISTS[dialect]
    each = df.select(F.explode(F.try_variant_get(_variant(payload), where, "array<variant>")).alias("c"))
    get = lambda n: F.try_variant_get("c", fields[n], "string") if n in fields else F.lit(None).cast("string")
    return each.select(*(get(n).alias(n) for n in ("name", "status", "conclusion", "url")))


def check_totals(df: DataFrame, dialect: str, key: str, payload: str = "payload") -> DataFrame:
    """(key, total): number of checks in each answer."""
    where, _ = CHECK_LISTS[dialect]
    return df.select(key, F.coalesce(F.size(F.try_variant_get(_variant(payload), where, "array<variant>")), F.lit(0)).alias("total"))


def wire_name(name: str | Column) -> Column:
    return F.replace(F.col(name) if isinstance(name, str) else name, F.lit("."), F.lit("__"))


def _answer(text: str | None) -> tuple:
    """(error, plan, action name as sent, arguments, result, whether it was a tool call) of a chat model's answer."""
    wrong = lambda why: (why, None, None, None, None, None)
    try:
        message = json.loads(text)["choices"][0]["message"]
        calls = message.get("tool_calls") or []
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return wrong("no assistant message")
    content = message.get("content")
    if calls:
        if len(calls) > 1:
            return wrong("more than one tool call")
        function = calls[0].get("function") or {}
        try:
            arguments = json.loads(function.get("arguments", "{}"))
        except (ValueError, TypeError, RecursionError):
            return wrong("arguments are not json")
        error, plan, name, given, _ = parse_decision(json.dumps({"plan": content or None, "action": {"name": function.get("name"), "arguments": arguments}}))
        return (error, None, None, None, None, None) if error else (None, plan, name, given, None, True)
    if not isinstance(content, str) or not content.strip():
        return wrong("neither a tool call nor content")
    error, plan, name, given, result = parse_decision(content)
    return (None, None, None, None, content.strip(), False) if error else (None, plan, name, given, result, False)


_ANSWER = T.StructType([*(T.StructField(n, T.StringType()) for n in ("error", "plan", "wire", "arguments", "result")), T.StructField("called", T.BooleanType())])


@F.pandas_udf(_ANSWER)
def parsed_answer(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in bodies:
        yield pd.DataFrame([_answer(t) for t in s], columns=["error", "plan", "wire", "arguments", "result", "called"], dtype=object)


def answers(df: DataFrame, tools: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with error, plan, action_name, arguments and result of a chat model's answer: exactly one tool call (its text
    is the plan), else a decision as JSON in the text, else the text as a result.

    ``tools`` (name) is the catalogue, of any size; wire names that are not in it are passed on as they are.
    """
    out = df.withColumn("_a", parsed_answer(body))
    known = sized(tools.select(wire_name("name").alias("_wire"), F.col("name").alias("_name")).where("_name IS NOT NULL").distinct())
    out = out.withColumn("_wire", F.col("_a.wire")).join(known, "_wire", "left")
    return out.select(*df.columns, "_a.error", "_a.plan", F.coalesce("_name", "_a.wire").alias("action_name"), "_a.arguments", "_a.result")


#: Characters of a change's diff that are kept, and files of one answer beyond which there may be more of them.
DIFF_MOST, DIFF_FILES = 500_000, 100


def diffs(df: DataFrame, dialect: str, payload: str = "payload", most: int = DIFF_MOST) -> DataFrame:
    """``df`` with diff and truncated of a change: the text itself, or (gitlab) the files' hunks, each behind its header."""
    if dialect != "gitlab":
        whole = F.col(payload)
        more = F.lit(False)
    else:
        files = F.try_variant_get(_variant(payload), "$", "array<variant>")
        get = lambda f, p: F.coalesce(F.try_variant_get(f, p, "string"), F.lit(""))
        whole = F.array_join(F.transform(files, lambda f: F.concat(F.lit("diff --git a/"), get(f, "$.old_path"), F.lit(" b/"), get(f, "$.new_path"), F.lit("\n"), get(f, "$.diff"))), "\n")
        more = F.coalesce(F.size(files) >= DIFF_FILES, F.lit(False))
    return df.withColumn("_d", whole).withColumn("diff", F.substring("_d", 1, most)).withColumn("truncated", (F.length("_d") > most) | more).drop("_d")
