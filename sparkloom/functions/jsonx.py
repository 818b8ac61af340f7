"""JSON texts: canonical form and the decisions of an assistant."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISION = T.StructType([T.StructField(n, T.StringType()) for n in ("error", "plan", "action_name", "arguments", "result")])


def canonical(value) -> str:
    """Keys sorted, no blanks, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _word(value) -> str:
    return value if isinstance(value, str) else str(value)


def parse_decision(text: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(error, plan, action name, canonical arguments, result) of one decision, given as JSON text.

    A decision is an object, or a JSON string that holds one, with exactly one of action and result; an action is an object
    with a non-blank name and an object of arguments (none is an empty one).
    """
    wrong = lambda why: (why, None, None, None, None)
    try:
        value = json.loads(text) if text is not None else None
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return wrong("not json")
    if not isinstance(value, dict):
        return wrong("not an object")
    plan = value.get("plan")
    plan = None if plan is None else _word(plan)
    has_action, result = "action" in value, value.get("result")
    if has_action == (result is not None):
        return wrong("needs exactly one of action and result")
    if not has_action:
        return None, plan, None, None, _word(result)
    action = value["action"]
    if not isinstance(action, dict):
        return wrong("action is not an object")
    name, arguments = action.get("name"), action.get("arguments", {})
    if not isinstance(name, str) or not name.strip():
        return wrong("action has no name")
    if not isinstance(arguments, dict):
        return wrong("arguments are not an object")
    return None, plan, name.strip(), canonical(arguments), None


@F.pandas_udf(DECISION)
def decision(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([parse_decision(t) for t in s], columns=["error", "plan", "action_name", "arguments", "result"], dtype=object)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Canonical form of JSON texts, null where they do not parse."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def are_json(s: pd.Series) -> pd.Series:
    """For an array of texts, which of them are JSON as a whole (``try_parse_json`` takes a text that only begins as JSON)."""

    def one(t) -> bool:
        try:
            json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    return s.map(lambda a: None if a is None else [one(t) for t in a], na_action=None)


def canonical_plain(text: Column | str) -> Column:
    """Canonical form without Python, for JSON without fractions (which the variant type writes in its own way)."""
    return F.to_json(F.try_parse_json(text))
