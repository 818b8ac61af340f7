"""A registry of named transforms: frames in, a frame out, with arguments checked against a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkloom.functions.schema_rules import violations


@dataclass(frozen=True)
class Transform:
    name: str
    run: Callable[..., DataFrame]
    arguments: dict
    description: str = ""


class Transforms:
    """Names are unique; ``specs`` lists them in order."""

    def __init__(self) -> None:
        self._known: dict[str, Transform] = {}

    def register(self, name: str, run: Callable[..., DataFrame], arguments: dict | None = None, description: str = "") -> Transform:
        if name in self._known:
            raise ValueError(f"a transform named {name} is there already")
        schema = {"type": "object", "properties": arguments or {}, "additionalProperties": False, "required": [n for n, r in (arguments or {}).items() if r.get("required")]}
        self._known[name] = Transform(name, run, schema, description or (run.__doc__ or "").strip().split("\n")[0])
        return self._known[name]

    @property
    def specs(self) -> list[Transform]:
        return [self._known[n] for n in sorted(self._known)]

    def apply(self, name: str, df: DataFrame, **arguments) -> DataFrame:
        """Unknown names and arguments that break the schema are errors before anything runs."""
        if name not in self._known:
            raise KeyError(f"no transform named {name}")
        wrong = next(violations(self._known[name].arguments, arguments), None)
        if wrong:
            raise ValueError(wrong)
        return self._known[name].run(df, **arguments)

    def chain(self, df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
        for name, arguments in steps:
            df = self.apply(name, df, **arguments)
        return df
