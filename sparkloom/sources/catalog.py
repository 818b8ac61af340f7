"""The catalogue of tools that conversations may call, as a table and as argument schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXT, _FLAG, _OPTIONAL = {"type": "string"}, {"type": "boolean"}, {"type": ["string", "null"]}
_POSITIVE = {"type": "integer", "minimum": 1}


def _must(**rule) -> dict:
    return {**rule, "required": True}


_NEEDED, _NUMBER = _must(**_TEXT), _must(**_POSITIVE)

# Names, arguments and bounds.
TOOLS: dict[str, dict[str, dict]] = {
    "workspace.list": {"path": _TEXT, "limit": {**_POSITIVE, "maximum": 500}},
    "workspace.read": {"path": _NEEDED, "start_line": _POSITIVE, "end_line": {"type": ["integer", "null"], "minimum": 1}},
    "workspace.search": {"query": _must(**_TEXT, minLength=1, maxLength=500), "path": _TEXT, "regex": _FLAG, "limit": {**_POSITIVE, "maximum": 200}},
    "workspace.write": {"path": _NEEDED, "content": _NEEDED, "expected_sha256": _must(**_OPTIONAL)},
    "workspace.replace": {"path": _NEEDED, "old_text": _NEEDED, "new_text": _NEEDED, "expected_sha256": _NEEDED, "expected_occurrences": _POSITIVE},
    "shell.run": {"argv": _must(type="array", items=_TEXT, minItems=1), "cwd": _TEXT},
    "git.revision": {},
    "git.status": {},
    "git.diff": {"staged": _FLAG, "path": _OPTIONAL},
    "git.create_branch": {"name": _NEEDED, "expected_head": _NEEDED},
    "git.commit": {"message": _NEEDED, "paths": _must(type="array", items=_TEXT, minItems=1), "expected_head": _NEEDED},
    "git.push": {"remote": _NEEDED, "branch": _NEEDED, "expected_head": _NEEDED},
    "provider.get_change": {"number": _NUMBER},
    "provider.get_checks": {"sha": _NEEDED},
    "provider.get_diff": {"number": _NUMBER},
    "provider.open_change": {"title": _NEEDED, "body": _NEEDED, "head_branch": _NEEDED, "base_branch": _NEEDED},
    "provider.approve_change": {"number": _NUMBER, "expected_sha": _NEEDED, "body": _NEEDED},
    "provider.merge_change": {"number": _NUMBER, "expected_sha": _NEEDED, "method": _must(enum=["merge", "squash", "rebase"])},
}


def schema(arguments: dict[str, dict]) -> dict:
    """JSON schema of one tool's arguments; fields that it does not name are refused."""
    fields = {n: {k: v for k, v in rule.items() if k != "required"} for n, rule in arguments.items()}
    return {"type": "object", "properties": fields, "required": [n for n, rule in arguments.items() if rule.get("required")], "additionalProperties": False}


def schemas(tools: dict[str, dict[str, dict]] | None = None) -> dict[str, dict]:
    return {n: schema(a) for n, a in (TOOLS if tools is None else tools).items()}


def tool_table(spark: SparkSession, tools: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """(name, wire_name, parameters) of the tools, by name; parameters is the schema as canonical JSON."""
    from sparkloom.functions.jsonx import canonical

    rows = [(n, n.replace(".", "__"), canonical(s)) for n, s in sorted(schemas(tools).items())]
    return spark.createDataFrame(rows, "name STRING, wire_name STRING, parameters STRING")
