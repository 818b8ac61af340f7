import json
import random

from conftest import MESSAGE, message
from pyspark.sql import functions as F

from sparkloom.operators import trajectories as tr

ACTION = json.dumps({"name": "workspace.read", "arguments": {"path": "a", "n": 1.0}})
RESULT = json.dumps({"result": "Done."})


def frame(spark, *records):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(records)], f"id BIGINT, messages ARRAY<{MESSAGE}>")


def test_canonical_forms_and_errors(spark):
    u = message("user", "go")
    records = [
        [u, message("assistant", "think", channel="plan"), message("assistant", action=ACTION), message("tool", "{}", "workspace.read"), message("assistant", "Done.", channel="result")],
        [u, message("assistant", decision=json.dumps({"plan": "p", "action": json.loads(ACTION)}))],
        [u, message("assistant", "think", channel="plan"), u],
        [u, message("assistant", "think", channel="plan"), message("assistant", "again", channel="plan")],
        [u, message("assistant", "think", channel="plan")],
        [u, message("assistant", "think", channel="plan"), message("assistant", decision=RESULT)],
        [u, message("assistant", "plain words")],
        [u, message("assistant", RESULT)],
        [u, message("assistant", decision=json.dumps({"result": "x", "action": json.loads(ACTION)}))],
        [u, message("assistant", decision=json.dumps({"action": None}))],
        [u, message("assistant", decision=json.dumps({"action": {"name": " ", "arguments": {}}}))],
        [],
    ]
    got = {r.id: r.c for r in frame(spark, *records).select("id", tr.canonicalize("messages").alias("c")).collect()}
    assert [got[i].error for i in range(12)] == [None, None, "plan without action or result", "two plans in a row", "record ends with a plan", "decision after a separate plan", None, None, "needs exactly one of action and result", "action is not an object", "action has no name", None]
    first = got[0].messages
    assert [m.role for m in first] == ["user", "assistant", "tool", "assistant"] and first[1].plan == "think" and first[1].arguments == '{"n":1.0,"path":"a"}' and first[3].result == "Done."
    assert got[6].messages[1].result == "plain words" and got[7].messages[1].result == "Done." and got[11].messages == []


def test_serialized_segments(spark):
    df = frame(spark, [message("system", "s"), message("assistant", "think", channel="plan"), message("assistant", action=ACTION), message("tool", "out", None), message("assistant", "é\"q", channel="result")], [message("admin", "x")])
    got = {r.id: r for r in tr.serialize(df).collect()}
    s = got[0].segments
    assert [x.learns for x in s] == [False, False, True, False, True, False]
    assert s[0].text == "<|bos|>" and s[-1].text == "<|eos|>" and s[1].text == "<|system|>\ns\n<|turn_end|>\n"
    assert s[2].text == '<|assistant|>\n<|plan|>\nthink\n<|action|>\n{"arguments":{"n":1.0,"path":"a"},"name":"workspace.read"}\n<|turn_end|>\n'
    assert s[3].text == "<|observation|>\nname=environment\nout\n<|turn_end|>\n" and s[4].text == '<|assistant|>\n<|result|>\né"q\n<|turn_end|>\n'
    assert got[1].error == "unsupported role" and got[1].segments is None
    c = frame(spark, [message("assistant", "é\"q", channel="result")]).select(tr.canonicalize("messages").alias("c")).select(tr.decision_json(F.col("c.messages")[0]).alias("d")).first().d
    assert json.loads(c) == {"result": 'é"q'} and c == json.dumps({"result": 'é"q'}, ensure_ascii=False, separators=(",", ":"))


def test_plain_segments_equal_serialized_ones(spark):
    rng = random.Random(5)
    words = ["", "a", *map(chr, range(1, 32)), "\x7f", '"', "\\", "/", "é", "\u2028", "😀", "\n", " x "]
    text = lambda: rng.choice([None, "", "".join(rng.choices(words, k=rng.randrange(9)))])
    action = lambda: {"name": "".join(rng.choices(words, k=5)), "arguments": {text() or "k": rng.choice([1, 1.5, None, text()])}}
    decision = lambda: {"plan": text()} | rng.choice([{"action": action()}, {"result": text()}, {"result": 1}])

    def turn():
        if rng.random() < 0.5:
            return message(rng.choice(["system", "user", "tool", "observation", "tool", "user", rng.choice([None, "admin", "user"])]), text(), text())
        return rng.choice([lambda: message("assistant", text(), channel=rng.choice([None, "result", "plan"])), lambda: message("assistant", action=json.dumps(action())), lambda: message("assistant", decision=json.dumps(decision()))])()

    rows = [(i, None if i % 97 == 0 else [None if rng.random() < 0.01 else turn() for _ in range(rng.randrange(5))]) for i in range(2000)]
    df = spark.createDataFrame(rows, f"id BIGINT, messages ARRAY<{MESSAGE}>")
    got = {r.id: r.messages and [m and m.asDict() for m in r.messages] for r in df.collect()}
    want = {r.id: None if r.segments is None else [tuple(s) for s in r.segments] for r in tr.serialize(df).collect()}
    assert {i: tr.plain_segments(m) for i, m in got.items()} == want and 300 < sum(s is None for s in want.values()) < 1500


def test_observations_must_match(spark):
    a = message("assistant", action=ACTION)
    t = message("tool", "{}", "workspace.read")
    df = frame(spark, [a, t], [a, message("user", "x"), t], [a, t, t], [message("assistant", decision=RESULT), t], [message("user", "x")], [a, message("tool", "{}", "git.diff")])
    got = {r.id: r.e for r in df.select("id", tr.observation_errors(F.col("messages")).alias("e")).collect()}
    bad = "observation does not match the action"
    assert got == {0: None, 1: None, 2: bad, 3: bad, 4: "no decision", 5: bad}


def test_cases(spark):
    df = frame(spark, [message("user", "q"), message("assistant", "a0"), message("tool", "t"), message("assistant", "a1")], [message("user", "q")])
    for selector, want in ((0, (0, 1, "a0")), (1, (1, 3, "a1")), (5, (1, 3, "a1"))):
        r = tr.with_case(df, F.lit(selector)).collect()
        assert len(r) == 1 and (r[0].ordinal, len(r[0].prefix), r[0].target.content) == want and r[0].assistant_count == 2


def test_chat_turns(spark):
    talk = [message("system", "s"), message("assistant", "think", channel="plan"), message("assistant", action=ACTION), message("tool", "x", "git.diff"), message("observation", None), message("user", None), message("assistant", None)]
    df = frame(spark, talk, [message("narrator", "n")], [message("assistant", "p", channel="plan")], [])
    got = {r.id: (r.error, r.turns and [tuple(m) for m in r.turns]) for r in tr.chat_turns(df).collect()}
    decision = '{"action":{"arguments":{"n":1.0,"path":"a"},"name":"workspace.read"},"plan":"think"}'
    assert got[0] == (None, [("system", "s"), ("assistant", decision), ("user", "OBSERVATION[git.diff]\nx"), ("user", "OBSERVATION[environment]\n"), ("user", ""), ("assistant", '{"result":""}')])
    assert got[1] == ("unsupported role", None) and got[2] == ("record ends with a plan", None) and got[3] == (None, [])
    asked = df.select(tr.request_turns(F.col("messages"), "do").alias("t")).first().t
    assert [tuple(m) for m in asked] == [("system", "do"), ("system", "s"), ("assistant", "think"), ("assistant", ACTION), ("user", "OBSERVATION[git.diff]\nx"), ("user", ""), ("assistant", "")]


def test_generated_conversations(spark):
    a, t, tools = message("assistant", action=ACTION), message("tool", "{}", "workspace.read"), ("workspace.read",)
    other = message("assistant", action=json.dumps({"name": "no.such", "arguments": {}}))
    df = frame(spark, [a, t, message("assistant", decision=RESULT)], [a, message("user", "x"), t], [other, t], [a, t, t], [a, message("tool", "12 passed", "workspace.read")], [message("user", "x")], [a, message("observation", "{}", "workspace.read")], [a, message("tool", None, "workspace.read")])
    c = df.select("id", tr.canonicalize("messages").alias("c"))
    got = {r.id: r.e for r in c.select("id", tr.generated_error(F.col("c.messages"), tools).alias("e")).collect()}
    no = "observation does not match the action"
    assert got == {0: None, 1: None, 2: "unknown action", 3: no, 4: "observation is not json", 5: "no decision", 6: "unsupported role", 7: "observation is not json"}


def test_context_carries_a_notice(spark):
    df = frame(spark, [message("system", "s"), message("user", "u"), message("tool", "x" * 50), message("user", None), message("tool", "y" * 10)], [message("system", "s")])
    size = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))).cast("bigint"))
    got = {r.id: [tuple(m) for m in r.t] for r in df.select("id", tr.context(F.col("messages"), size, 20).alias("t")).collect()}
    assert got == {0: [("system", "s"), ("user", "u"), ("system", tr.NOTICE), ("user", ""), ("tool", "y" * 10)], 1: [("system", "s")]}


def test_budget_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(1, 40) for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id BIGINT, sizes ARRAY<BIGINT>")
    got = {r.id: r.k for r in df.select("id", tr.within_budget(F.col("sizes"), 100).alias("k")).collect()}
    for i, sizes in enumerate(rows):
        want = list(range(len(sizes)))
        if sum(sizes) > 100:
            left, last = 100 - sum(sizes[:2]), []
            for j in range(len(sizes) - 1, 1, -1):
                if sizes[j] > left:
                    break
                left -= sizes[j]
                last.insert(0, j)
            want = [0, 1, *last]
        assert got[i] == want, (sizes, got[i])
