"""Secrets in nested JSON: every string of a value is cut and redacted, keys and numbers stay."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.functions.text import RECORDED_SECRETS

_SECRETS = tuple(map(re.compile, RECORDED_SECRETS))


def redact_string(text: str, most: int | None, mark: str = "<REDACTED>") -> str:
    text = text if most is None else text[:most]
    for pattern in _SECRETS:
        text = pattern.sub(mark, text)
    return text


def redact_value(value, most: int | None = 50_000):
    """``value`` with all its strings redacted, at any depth; without recursion, so depth is bounded by the parser only."""
    holder = [value]
    todo: list = [(holder, 0)]
    while todo:
        at, k = todo.pop()
        v = at[k]
        if isinstance(v, str):
            at[k] = redact_string(v, most)
        elif isinstance(v, dict):
            at[k] = dict(v)
            todo += [(at[k], x) for x in v]
        elif isinstance(v, list):
            at[k] = list(v)
            todo += [(at[k], i) for i in range(len(v))]
    return holder[0]


def redact_json(text: str | Column, most: int | None = 50_000) -> Column:
    """JSON texts with their strings redacted one by one, in canonical form; texts that are no JSON are redacted as a whole,
    null stays null."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if t is None:
                return None
            try:
                value = json.loads(t)
            except (ValueError, RecursionError):
                return redact_string(t, most)
            return json.dumps(redact_value(value, most), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        for s in batches:
            yield s.map(one, na_action=None)

    return run(text)
