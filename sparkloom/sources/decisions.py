"""Where decisions come from: a table of scripted ones, or any callable that is made once in each task."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DecisionSource(Protocol):
    """Answers of a model, or of something that stands for one: one text for each request, in order."""

    def __call__(self, requests: list[list[dict]]) -> list[str]: ...


def scripted(requests: DataFrame, script: DataFrame) -> DataFrame:
    """``requests`` (run, step, ...) with the decision that ``script`` (run, step, decision) has for them, and error where it
    has none or more than one."""
    one = script.groupBy("run", "step").agg(F.max("decision").alias("decision"), F.count("*").alias("_n"))
    out = requests.drop("decision", "error").join(one, ["run", "step"], "left")
    error = F.when(F.col("_n").isNull(), "the script has ended").when(F.col("_n") > 1, "two scripted decisions")
    return out.withColumn("error", error).withColumn("decision", F.when(F.col("_n") == 1, F.col("decision"))).drop("_n")


def decide(requests: DataFrame, factory: Callable[[], DecisionSource], turns: str = "turns") -> DataFrame:
    """``requests`` with body, the answer of the source to the turns (an array of role and content) of each row, and error.

    ``factory`` is called once in each task, so connections and models are made where they are used. A batch that fails is
    asked row by row, and a row's failure is its error; nothing else is lost.
    """
    names = [c for c in requests.columns if c not in ("body", "error")]
    schema = T.StructType([requests.schema[c] for c in names] + [T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = factory()
        for b in batches:
            asked = [[{"role": m["role"], "content": m["content"]} for m in t or ()] for t in b.column(names.index(turns)).to_pylist()]
            bodies, errors = [None] * len(asked), [None] * len(asked)
            try:
                bodies = list(source(asked))
                if len(bodies) != len(asked):
                    raise ValueError("the source gave another number of answers")
            except Exception:
                bodies = [None] * len(asked)
                for i, turn in enumerate(asked):
                    try:
                        bodies[i] = source([turn])[0]
                    except Exception as e:
                        errors[i] = f"{type(e).__name__}: {e}"[:500]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [*names, "body", "error"])

    return requests.select(*names).mapInArrow(run, schema)


class ChatEndpoint:
    """A chat-completions endpoint as a decision source; ``send`` (url, headers, bytes) -> bytes can be replaced."""

    def __init__(self, url: str, model: str, tools: list[dict] | None = None, key: str | None = None, timeout: float = 120.0, send: Callable | None = None):
        self.url, self.model, self.tools, self.key, self.timeout = url.rstrip("/") + "/chat/completions", model, tools or [], key, timeout
        self.send = send or self._post

    def _post(self, url: str, headers: dict, body: bytes) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=self.timeout) as r:
            return r.read()

    def __call__(self, requests: list[list[dict]]) -> list[str]:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        out = []
        for messages in requests:
            body = {"model": self.model, "messages": messages, "temperature": 0, **({"tools": self.tools, "tool_choice": "auto"} if self.tools else {})}
            out.append(self.send(self.url, headers, json.dumps(body).encode()).decode("utf-8"))
        return out


def wire_tools(schemas: dict[str, dict], descriptions: dict[str, str] | None = None) -> list[dict]:
    """Tools in the form that chat endpoints expect, by name."""
    return [{"type": "function", "function": {"name": n.replace(".", "__"), "description": (descriptions or {}).get(n, n), "parameters": s}} for n, s in sorted(schemas.items())]
