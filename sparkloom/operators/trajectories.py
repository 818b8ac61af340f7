"""Conversations of agents: canonical decisions, serialized segments, validation, cases and portable messages.

Messages are arrays of one row and stay so: whatever needs neighbours or order works inside the array, without exploding
or shuffling. Only parsing of JSON decisions uses Python, by Arrow batches over whole arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.jsonx import are_json, parse_decision
from sparkloom.functions.text import let

# Marks of the serialized layout.
BOS, EOS, TURN_END = "<|bos|>", "<|eos|>", "<|turn_end|>"
PLAN, ACTION, RESULT = "<|plan|>", "<|action|>", "<|result|>"
ROLE_MARKS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>", "tool": "<|observation|>", "observation": "<|observation|>"}

FIELDS = ("role", "name", "content", "plan", "action_name", "arguments", "result")
CANONICAL = T.StructType([T.StructField("error", T.StringType()), T.StructField("messages", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in FIELDS])))])


def canonical_messages(messages) -> tuple[str | None, list[dict] | None]:
    """(error, messages) of one record: every assistant turn becomes one decision.

    A separate plan belongs to the next message, which must be an assistant's action, result or text; the first rule that a
    record breaks is its error, and it has no messages then.
    """
    out, plan = [], None
    for m in messages if messages is not None else ():
        if m is None:
            return "message is not an object", None
        if m["role"] != "assistant":
            if plan is not None:
                return "plan without action or result", None
            out.append({"role": m["role"], "name": m["name"], "content": m["content"]})
            continue
        content = m["content"] or ""
        if m["channel"] == "plan":
            if plan is not None:
                return "two plans in a row", None
            plan = content
            continue
        if m["decision"] is not None:
            if plan is not None:
                return "decision after a separate plan", None
            source = m["decision"]
        elif m["action"] is not None:
            try:
                source = json.dumps({"action": json.loads(m["action"])})
            except ValueError:
                return "not json", None
        elif m["channel"] == "result":
            source = json.dumps({"result": content})
        else:
            source = content if parse_decision(content)[0] is None else json.dumps({"result": content})
        error, own_plan, name, arguments, result = parse_decision(source)
        if error:
            return error, None
        if plan is not None and own_plan is not None:
            return "two plans for one decision", None
        out.append({"role": "assistant", "plan": own_plan if plan is None else plan, "action_name": name, "arguments": arguments, "result": result})
        plan = None
    return ("record ends with a plan", None) if plan is not None else (None, out)


@F.pandas_udf(CANONICAL)
def canonicalize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = []
        for messages in s:
            error, out = canonical_messages(messages)
            rows.append((error, None if out is None else [{n: m.get(n) for n in FIELDS} for m in out]))
        yield pd.DataFrame(rows, columns=["error", "messages"], dtype=object)


def json_text(c: Column) -> Column:
    """A string column as a JSON string."""
    quoted = F.to_json(F.array(c))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def action_json(m: Column) -> Column:
    return F.concat(F.lit('{"arguments":'), m["arguments"], F.lit(',"name":'), json_text(m["action_name"]), F.lit("}"))


def decision_json(m: Column) -> Column:
    """Canonical JSON of a decision (keys sorted)."""
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(m["action_name"].isNotNull(), F.concat(F.lit('"action":'), action_json(m))),
            F.when(m["plan"].isNotNull(), F.concat(F.lit('"plan":'), json_text(m["plan"]))),
            F.when(m["action_name"].isNull(), F.concat(F.lit('"result":'), json_text(m["result"]))),
        ),
        F.lit("}"),
    )


def message_content(m: Column) -> Column:
    """Text of a canonical message: sections of a decision, name and content of an observation, else the content."""
    action = F.concat(F.lit(f"{ACTION}\n"), action_json(m))
    decision = F.concat_ws(
        "\n",
        F.when(m["plan"].isNotNull(), F.concat(F.lit(f"{PLAN}\n"), m["plan"])),
        F.when(m["action_name"].isNotNull(), action).otherwise(F.concat(F.lit(f"{RESULT}\n"), F.coalesce(m["result"], F.lit("")))),
    )
    seen = F.concat(F.lit("name="), F.coalesce(m["name"], F.lit("environment")), F.lit("\n"), F.coalesce(m["content"], F.lit("")))
    return F.when(m["role"] == "assistant", decision).when(m["role"].isin("tool", "observation"), seen).otherwise(F.coalesce(m["content"], F.lit("")))


def segments(messages: Column) -> Column:
    """Array of struct(text, learns) of canonical messages, between begin and end marks; only assistant turns are learnt."""
    mark = F.create_map(*[F.lit(x) for kv in ROLE_MARKS.items() for x in kv])
    piece = lambda text, learns: F.struct(text.alias("text"), learns.alias("learns"))
    turns = F.transform(messages, lambda m: piece(F.concat(F.try_element_at(mark, m["role"]), F.lit("\n"), message_content(m), F.lit(f"\n{TURN_END}\n")), F.coalesce(m["role"] == "assistant", F.lit(False))))
    return F.concat(F.array(piece(F.lit(BOS), F.lit(False))), turns, F.array(piece(F.lit(EOS), F.lit(False))))


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def plain_segments(messages) -> list[tuple[str, bool]] | None:
    """(text, learns) of the ``segments`` of one raw record, as ``serialize`` gives them; None for a record with an error.

    For what runs in Python anyway: one worker a task then takes messages to their end, without a second one for the decisions.
    """
    error, turns = canonical_messages(messages)
    if error or any(m["role"] not in ROLE_MARKS for m in turns):
        return None
    quoted = lambda t: '"' + re.sub(r'["\\\x00-\x1f]', lambda c: _ESCAPES.get(c[0]) or f"\\u{ord(c[0]):04X}", t) + '"'

    def content(m: dict) -> str:
        if m["role"] == "assistant":
            plan = f"{PLAN}\n{m['plan']}\n" if m["plan"] is not None else ""
            return plan + (f"{RESULT}\n{m['result'] or ''}" if m["action_name"] is None else f'{ACTION}\n{{"arguments":{m["arguments"]},"name":{quoted(m["action_name"])}}}')
        seen = f"name={'environment' if m['name'] is None else m['name']}\n" if m["role"] in ("tool", "observation") else ""
        return seen + (m["content"] or "")

    return [(BOS, False), *((f"{ROLE_MARKS[m['role']]}\n{content(m)}\n{TURN_END}\n", m["role"] == "assistant") for m in turns), (EOS, False)]


def unknown_role(messages: Column) -> Column:
    return F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLE_MARKS), F.lit(False)))


def serialize(df: DataFrame, messages: str = "messages") -> DataFrame:
    """``df`` with error and segments of its conversations; a record with an error has no segments."""
    known = df.withColumn("_c", canonicalize(messages))
    error = F.coalesce("_c.error", F.when(unknown_role(F.col("_c.messages")), "unsupported role"))
    return known.withColumn("error", error).withColumn("segments", F.when(F.col("error").isNull(), segments(F.col("_c.messages")))).drop("_c")


def training_text(text: Column, pieces: Column) -> Column:
    """A record's own text, else its segments put together."""
    return F.coalesce(text, F.array_join(F.transform(pieces, lambda s: s["text"]), ""))


def observation_errors(messages: Column) -> Column:
    """First error of the tool turns of a raw conversation in legacy form, by neighbours within the array:

    the name of a tool turn must be the action of the last assistant turn before it, with no other tool turn between.
    """
    name = lambda m: F.coalesce(F.get_json_object(m["action"], "$.name"), F.get_json_object(m["decision"], "$.action.name"))

    def first_error(turns: Column) -> Column:
        before = lambda i: F.get(turns, i - 1)
        fits = lambda m, i: F.coalesce((before(i)["role"] == "assistant") & (name(before(i)) == m["name"]), F.lit(False))
        wrong = F.exists(F.transform(turns, lambda m, i: (m["role"] == "tool") & ~fits(m, i)), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(wrong, "observation does not match the action").when(~F.exists(turns, lambda m: m["role"] == "assistant"), "no decision")

    return let(F.filter(messages, lambda m: m["role"].isin("assistant", "tool")), first_error)


def assistant_positions(messages: Column) -> Column:
    numbered = F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def with_case(df: DataFrame, selector: Column, messages: str = "messages") -> DataFrame:
    """``df`` with ordinal, assistant_count, prefix (messages before the target) and target (that message).

    The target is assistant turn number ``selector`` modulo the number of assistant turns; records without any are dropped.
    """
    at = assistant_positions(F.col(messages))
    some = df.withColumn("_at", at).where(F.size("_at") > 0)
    some = some.withColumn("assistant_count", F.size("_at")).withColumn("ordinal", F.pmod(selector, F.col("assistant_count").cast("bigint")).cast("int"))
    pos = F.get("_at", F.col("ordinal"))
    return some.withColumn("prefix", F.slice(messages, F.lit(1), pos)).withColumn("target", F.get(messages, pos)).drop("_at")


def quoted_observation(m: Column, default_name: str) -> Column:
    return F.concat(F.lit("OBSERVATION["), F.coalesce(m["name"], F.lit(default_name)), F.lit("]\n"), F.coalesce(m["content"], F.lit("")))


def _turn(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def chat_turns(df: DataFrame, messages: str = "messages") -> DataFrame:
    """``df`` with error and turns (role, content): chat turns of system, user and assistant only, for training.

    Messages are canonicalized first: an assistant turn is the canonical JSON of its decision, an observation a user turn that
    quotes it. A record that breaks a rule, or has another role, has an error and no turns.
    """
    known = df.withColumn("_c", canonicalize(messages))
    error = F.coalesce("_c.error", F.when(unknown_role(F.col("_c.messages")), "unsupported role"))
    content = lambda m: F.when(m["role"] == "assistant", decision_json(m)).when(m["role"].isin("tool", "observation"), quoted_observation(m, "environment")).otherwise(F.coalesce(m["content"], F.lit("")))
    role = lambda m: F.when(m["role"].isin("tool", "observation"), "user").otherwise(m["role"])
    turns = F.transform("_c.messages", lambda m: _turn(role(m), content(m)))
    return known.withColumn("error", error).withColumn("turns", F.when(F.col("error").isNull(), turns)).drop("_c")


def request_turns(messages: Column, instruction: str) -> Column:
    """Chat turns for a model endpoint: the instruction, then system, user and assistant turns as they are (a decision where
    an assistant turn has no content) and tool turns as user turns that quote them; other roles are left out."""
    kept = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool"))
    content = lambda m: F.when(m["role"] == "tool", quoted_observation(m, "tool")).otherwise(F.coalesce(m["content"], m["decision"], m["action"], F.lit("")))
    role = lambda m: F.when(m["role"] == "tool", "user").otherwise(m["role"])
    return F.concat(F.array(_turn(F.lit("system"), F.lit(instruction))), F.transform(kept, lambda m: _turn(role(m), content(m))))


def generated_error(canonical: Column, tools: tuple[str, ...]) -> Column:
    """First error, in order of the messages, of a generated conversation in canonical form.

    Actions must be of known ``tools``; a tool turn must name the action of the assistant turn before it, with no other tool
    turn between, and hold JSON; there are no roles but system, user, assistant and tool, and at least one decision.
    """

    def turn_error(turns: Column, t: Column, i: Column) -> Column:
        before, m = F.get(turns, i - 1)["m"], t["m"]
        fits = F.coalesce((before["role"] == "assistant") & (before["action_name"] == m["name"]), F.lit(False)) | ((before["role"] == "assistant") & before["action_name"].isNull() & m["name"].isNull())
        return F.coalesce(
            F.when((m["role"] == "assistant") & ~m["action_name"].isin(*tools), "unknown action"),
            F.when((m["role"] == "tool") & ~F.coalesce(fits, F.lit(False)), "observation does not match the action"),
            F.when((m["role"] == "tool") & ~t["valid"], "observation is not json"),
            F.when(~F.coalesce(m["role"].isin("assistant", "tool"), F.lit(False)), "unsupported role"),
        )

    def first(turns: Column) -> Column:
        errors = F.filter(F.transform(turns, lambda t, i: turn_error(turns, t, i)), lambda e: e.isNotNull())
        return F.coalesce(F.get(errors, F.lit(0)), F.when(~F.exists(turns, lambda t: F.coalesce(t["m"]["role"] == "assistant", F.lit(False))), "no decision"))

    checked = F.zip_with(canonical, are_json(F.transform(canonical, lambda m: m["content"])), lambda m, v: F.struct(m.alias("m"), v.alias("valid")))
    return let(F.filter(checked, lambda t: ~F.coalesce(t["m"]["role"].isin("system", "user"), F.lit(False))), first)


NOTICE = "Older tool turns were left out so that the context fits."


def within_budget(sizes: Column, budget: int, fixed: int = 2) -> Column:
    """Positions (from 0) of the messages kept for a context of ``budget``: all if they fit, else the first ``fixed`` and
    the longest run of last ones that fits into the rest. One pass over the sizes, from the last one on."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def kept(a: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(a) - 1)
        rest = F.reverse(F.slice(a, fixed + 1, F.greatest(F.size(a) - fixed, F.lit(0))))
        state = lambda left, n, open_: F.struct(left.alias("left"), n.alias("n"), open_.alias("open"))
        begin = state(F.lit(budget).cast("bigint") - total(F.slice(a, 1, fixed)), F.lit(0), F.lit(True))
        step = lambda s, x: F.when(s["open"] & (x <= s["left"]), state(s["left"] - x, s["n"] + 1, F.lit(True))).otherwise(state(s["left"], s["n"], F.lit(False)))
        tail = F.aggregate(rest, begin, step, lambda s: s["n"])
        some = F.filter(every, lambda i: (i < fixed) | (i >= F.size(a) - tail))
        return F.when(F.size(a) == 0, F.array().cast("array<int>")).when(total(a) <= budget, every).otherwise(some)

    return let(sizes, kept)


def context(messages: Column, sizes: Column, budget: int, fixed: int = 2, notice: str = NOTICE) -> Column:
    """Turns (role, content) that stay within ``budget``; where some were left out, a notice (not counted) stands after the
    first ``fixed`` ones."""
    pick = lambda at: F.transform(at, lambda i: _turn(F.get(messages, i)["role"], F.coalesce(F.get(messages, i)["content"], F.lit(""))))
    said = F.array(_turn(F.lit("system"), F.lit(notice)))
    return let(within_budget(sizes, budget, fixed), lambda k: F.when(F.size(k) >= F.size(messages), pick(k)).otherwise(F.concat(pick(F.slice(k, 1, fixed)), said, pick(F.filter(k, lambda i: i >= fixed)))))
