"""Checking JSON arguments against small JSON schemas, by Arrow batches; the first violation is the result."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def _own_violations(schema: dict, value) -> Iterator[str]:
    """Violations of ``value`` itself, without its fields and items."""
    kinds = schema.get("type")
    if kinds is not None and not any(k in KINDS and KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield "has the wrong type"
    if "enum" in schema and value not in schema["enum"]:
        yield "is not an allowed value"
    if isinstance(value, dict):
        yield from (f"lacks {name}" for name in schema.get("required", ()) if name not in value)
        extra = sorted(value.keys() - schema.get("properties", {}).keys()) if schema.get("additionalProperties") is False else []
        if extra:
            yield "has unknown fields " + ", ".join(extra)


def _size_violations(schema: dict, value) -> Iterator[str]:
    sizes = ((list, len, "minItems", "maxItems"), (str, len, "minLength", "maxLength"), (int, lambda v: v, "minimum", "maximum"))
    for kind, measure, low, high in sizes:
        if isinstance(value, kind) and not isinstance(value, bool):
            if low in schema and measure(value) < schema[low]:
                yield f"is below {low} {schema[low]}"
            if high in schema and measure(value) > schema[high]:
                yield f"is above {high} {schema[high]}"


def violations(schema: dict, value, place: str = "arguments") -> Iterator[str]:
    """All violations with their places: those of a value, then of its fields; sizes of arrays come before their items,
    other sizes last."""
    yield from (f"{place} {w}" for w in _own_violations(schema, value))
    if isinstance(value, list):
        yield from (f"{place} {w}" for w in _size_violations(schema, value))
        for i, item in enumerate(value):
            yield from violations(schema.get("items") or {}, item, f"{place}[{i}]")
    elif isinstance(value, dict):
        for name, item in value.items():
            yield from violations(schema.get("properties", {}).get(name, {}), item, f"{place}.{name}")
    else:
        yield from (f"{place} {w}" for w in _size_violations(schema, value))


def argument_error(schemas: dict[str, dict], tool: str | Column, arguments: str | Column) -> Column:
    """First violation of the tool's schema by the JSON arguments, null if there is none."""

    @F.pandas_udf(StringType())
    def check(tools: pd.Series, texts: pd.Series) -> pd.Series:
        def one(name, text):
            if name not in schemas:
                return "unknown tool"
            try:
                value = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                return "not json"
            return next(violations(schemas[name], value), None)

        return pd.Series([one(n, t) for n, t in zip(tools, texts)], dtype=object)

    return check(tool, arguments)
