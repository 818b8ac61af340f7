"""Deterministic synthetic conversations, as pure functions of their index, for tests and load.

A family is a sequence of tool calls, each with its arguments and what the tool answers, that ends in a result; every record is
a row of ``spark.range``, so any number is made in parallel, without data on the driver. Templates are filled by built-in
functions: digests of the index stand for ids, contents and revisions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step: tool, arguments, and the answer; answers that are an ``Exception`` come back as an error.
Step = tuple[str, dict, object]


def _failed(why: str) -> Exception:
    return RuntimeError(why)


_READ: Step = ("workspace.read", {"path": "src/§id.py"}, {"content": "def limit_§id():\n    return §n\n", "sha256": "§old"})
_TEST_OK: Step = ("shell.run", {"argv": ["pytest", "-q", "tests/test_§id.py"]}, {"exit_code": 0, "stdout": "1 passed"})
_CHANGE: Step = ("provider.get_change", {"number": 1}, {"number": 1, "state": "open", "head_sha": "§head", "title": "Raise the limit of §id"})
_DIFF: Step = ("provider.get_diff", {"number": 1}, {"number": 1, "diff": "-    return §n\n+    return §n + 1\n", "truncated": False})
_CHECKS: Step = ("provider.get_checks", {"sha": "§head"}, {"sha": "§head", "checks": [{"name": "unit", "status": "completed", "conclusion": "success"}], "total": 1})
_EDIT = {"path": "src/§id.py", "old_text": "return §n", "new_text": "return §n + 1", "expected_sha256": "§old", "expected_occurrences": 1}
_WRITE = {"path": "docs/§id.md", "content": "# §id\n\nThe limit is §n.\n", "expected_sha256": None}

# Names of the families in their order, and the tools that each calls before it reports its result.
FAMILIES: dict[str, tuple[str, tuple[Step, ...], str]] = {
    "inspect": ("Say what the limit of §id is.", (("workspace.list", {"path": "src", "limit": 50}, {"entries": ["§id.py"], "truncated": False}), _READ), "The limit of §id is §n."),
    "edit_and_test": ("Raise the limit of §id by one and run its test.", (_READ, ("workspace.replace", _EDIT, {"path": "src/§id.py", "sha256": "§new"}), _TEST_OK), "Raised the limit; its test passes."),
    "create_and_test": ("Describe §id in docs and check the links.", (("workspace.list", {"path": "docs", "limit": 50}, {"entries": [], "truncated": False}), ("workspace.write", _WRITE, {"path": "docs/§id.md", "sha256": "§new"}), _TEST_OK), "Wrote docs/§id.md; the check passes."),
    "git_to_change": (
        "Put the description of §id on a branch and open a change.",
        (
            ("git.status", {}, {"porcelain": "## main", "clean": True}),
            ("git.create_branch", {"name": "docs-§id", "expected_head": "§head"}, {"branch": "docs-§id"}),
            ("workspace.write", _WRITE, {"path": "docs/§id.md", "sha256": "§new"}),
            ("git.commit", {"message": "Describe §id", "paths": ["docs/§id.md"], "expected_head": "§head"}, {"sha": "§next"}),
            ("git.push", {"remote": "origin", "branch": "docs-§id", "expected_head": "§next"}, {"pushed": True}),
            ("provider.open_change", {"title": "Describe §id", "body": "Adds docs/§id.md.", "head_branch": "docs-§id", "base_branch": "main"}, {"number": 1, "head_sha": "§next"}),
        ),
        "Opened change 1 at §next.",
    ),
    "review_approve": ("Review change 1 and approve it if its checks pass.", (_CHANGE, _DIFF, _CHECKS, ("provider.approve_change", {"number": 1, "expected_sha": "§head", "body": "Read the diff; checks pass."}, {"approved": True})), "Approved change 1 at §head."),
    "review_block": ("Review change 1; do not approve what fails.", (_CHANGE, _DIFF, ("provider.get_checks", {"sha": "§head"}, {"sha": "§head", "checks": [{"name": "unit", "status": "completed", "conclusion": "failure"}], "total": 1})), "Not approved: the check unit fails at §head."),
    "review_merge": ("Merge change 1 if it is reviewed and its checks pass.", (_CHANGE, _DIFF, _CHECKS, ("provider.merge_change", {"number": 1, "expected_sha": "§head", "method": "squash"}, {"merged": True})), "Merged change 1 at §head."),
    "test_recovery": (
        "Make the test of §id pass.",
        (("shell.run", {"argv": ["pytest", "-q", "tests/test_§id.py"]}, {"exit_code": 1, "stdout": "assert §n == §n + 1"}), _READ, ("workspace.replace", _EDIT, {"path": "src/§id.py", "sha256": "§new"}), _TEST_OK, ("git.diff", {"staged": False}, {"diff": "-    return §n\n+    return §n + 1\n", "truncated": False})),
        "The test passes; only the limit was changed.",
    ),
    "stale_write_recovery": (
        "Update docs/§id.md without losing what others wrote.",
        (
            ("workspace.read", {"path": "docs/§id.md"}, {"content": "# §id\n", "sha256": "§old"}),
            ("workspace.write", {**_WRITE, "expected_sha256": "§old"}, _failed("the file changed since it was read: §next")),
            ("workspace.read", {"path": "docs/§id.md"}, {"content": "# §id\n\nBy others.\n", "sha256": "§next"}),
            ("workspace.write", {"path": "docs/§id.md", "content": "# §id\n\nBy others.\n\nThe limit is §n.\n", "expected_sha256": "§next"}, {"path": "docs/§id.md", "sha256": "§new"}),
        ),
        "Updated docs/§id.md on top of the newer text.",
    ),
    "permission_recovery": ("Run the deployment of §id.", (("shell.run", {"argv": ["deploy", "§id"]}, _failed("the command deploy is not allowed")),), "Not done: the command is not allowed here."),
}
SPLIT_OFFSETS = {"train": 0, "validation": 10_000, "eval": 20_000}
SYSTEM = "Use one tool a turn; finish after an observation."


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for mark, value in values.items():
        if mark in template:
            out = F.replace(out, F.lit(mark), value)
    return out


def _turn(role: str, content: Column | None = None, name: str | None = None, decision: Column | None = None) -> Column:
    empty = F.lit(None).cast("string")
    pick = lambda c: empty if c is None else c
    return F.struct(F.lit(role).alias("role"), pick(None if name is None else F.lit(name)).alias("name"), pick(content).alias("content"), empty.alias("channel"), empty.alias("action"), pick(decision).alias("decision"))


def _messages(family: str) -> Column:
    task, steps, result = FAMILIES[family]
    index = F.col("index").cast("string")
    digest = lambda what, n: F.substring(F.sha2(F.concat(F.lit(f"{family}-{what}-"), index), 256), 1, n)
    values = {"§id": F.concat(F.lit("m"), digest("id", 8)), "§n": F.pmod(F.col("index"), F.lit(90)).cast("string"), "§old": digest("old", 64), "§new": digest("new", 64), "§head": digest("head", 40), "§next": digest("next", 40)}
    values = {"§next": values.pop("§next"), "§new": values.pop("§new"), **values}  # longer marks before §n
    turns = [_turn("system", F.lit(SYSTEM)), _turn("user", _filled(task, values))]
    for k, (tool, arguments, answer) in enumerate(steps, 1):
        decision = {"action": {"arguments": arguments, "name": tool}, "plan": f"Step {k} of {len(steps)}: {tool}."}
        seen = {"error": str(answer), "ok": False} if isinstance(answer, Exception) else {"ok": True, "output": answer}
        turns.append(_turn("assistant", decision=_filled(_text(decision), values)))
        turns.append(_turn("tool", _filled(_text(seen), values), tool))
    turns.append(_turn("assistant", decision=_filled(_text({"result": result}), values)))
    return F.array(*turns)


def conversations(spark: SparkSession, per_family: int, first_index: int = 0, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """(family, index, messages) of ``per_family`` records of each family, indices from ``first_index``."""
    out = None
    for f in families:
        part = spark.range(first_index, first_index + per_family).select(F.lit(f).alias("family"), F.col("id").alias("index"), _messages(f).alias("messages"))
        out = part if out is None else out.union(part)
    return out


def dataset(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """(split, family, index, selector, messages) with disjoint index ranges; the selector turns over the decisions."""
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("bigint") - 1
    out = None
    for split, n in sizes.items():
        part = conversations(spark, n, SPLIT_OFFSETS[split]).withColumn("split", F.lit(split)).withColumn("selector", F.col("index") + order)
        out = part if out is None else out.union(part)
    return out


def evaluation_cases(data: DataFrame) -> DataFrame:
    """(family, index, prefix, expected) of each record: the messages before the decision that its selector picks, and it."""
    from sparkloom.operators.trajectories import with_case

    return with_case(data, F.col("selector")).select("family", "index", "ordinal", "assistant_count", "prefix", F.col("target.decision").alias("expected"))


#: Families of the smoke records, six for training and one for validation.
SMOKE = ("inspect", "edit_and_test", "create_and_test", "review_approve", "test_recovery", "permission_recovery"), ("review_block",)


def smoke_records(spark: SparkSession) -> DataFrame:
    """(split, family, messages): a handful of records that exercise a training run from end to end."""
    parts = [conversations(spark, 1, offset, families).select(F.lit(split).alias("split"), "family", "messages") for split, offset, families in (("train", 0, SMOKE[0]), ("validation", SPLIT_OFFSETS["validation"], SMOKE[1]))]
    return parts[0].union(parts[1])
