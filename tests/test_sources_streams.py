import json
import os
import subprocess

import pytest
from conftest import MESSAGE, message

from sparkloom.sources import git_tree, jsonl, payloads, sinks
from sparkloom.streaming import flows


def test_jsonl_keeps_lines(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"k": 1}\n\n[1]\n{"k": NaN, "k": 2}\n{bad\n' + "".join(json.dumps({"i": i, "pad": "x" * 50}) + "\n" for i in range(5000)))
    b.write_text('{"text": "t"}\n\t\n \x0b\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {(os.path.basename(r.file), r.line): (r.value, r.error) for r in jsonl.read_jsonl(spark, [str(a), str(b)]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows["a.jsonl", 3][1] == "not an object" and rows["a.jsonl", 5][1] == "not json" and ("a.jsonl", 2) not in rows and rows["a.jsonl", 4][1] is None and rows["b.jsonl", 1][1] is None
    assert all(json.loads(rows["a.jsonl", 6 + i][0])["i"] == i for i in range(0, 5000, 7)) and len(rows) == 5005
    need = jsonl.objects(jsonl.read_jsonl(spark, str(b)), ("messages", "text"))
    assert need.first().error == "missing messages"
    with pytest.raises(ValueError, match="b.jsonl:1: missing"):
        jsonl.objects(jsonl.read_jsonl(spark, str(b)), ("messages",), strict=True)


def test_inputs_keep_their_order(spark):
    u = jsonl.in_order([spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([(2, "y")], "x INT, y STRING")])
    assert sorted(tuple(r) for r in u.select("x", "input").collect()) == [(1, 0), (2, 1)]


def test_jsonl_writes_sorted_keys(spark, tmp_path):
    df = spark.createDataFrame([("é", None, 1)], "b STRING, c STRING, a INT")
    sinks.write_jsonl(df, f"file://{tmp_path}/x")
    sinks.append_jsonl(df, f"file://{tmp_path}/x")
    assert [r.value for r in spark.read.text(f"{tmp_path}/x").collect()] == ['{"a":1,"b":"é","c":null}'] * 2
    sinks.write_jsonl(df, f"file://{tmp_path}/y", nulls=False)
    assert [r.value for r in spark.read.text(f"{tmp_path}/y").collect()] == ['{"a":1,"b":"é"}']
    for n in (1, 2):
        sinks.write_report(spark, f"file://{tmp_path}/report.json", {"n": n})
    assert json.loads((tmp_path / "report.json").read_text()) == {"n": 2} and not list(tmp_path.glob("*.tmp"))


def test_git_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b" / "c.txt").write_text("12345")
    (tmp_path / "a" / "b.txt").write_text("x")
    os.symlink("b.txt", tmp_path / "a" / "link")
    run("add", "-A")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "m")
    (tmp_path / "untracked").write_text("u")
    spark.dataSource.register(git_tree.GitTreeSource)
    rows = spark.read.format("git_tree").option("checkouts", f"o/r={tmp_path}").option("max_bytes", "3").load().collect()
    assert git_tree.tracked(str(tmp_path)) == ["a/b.txt", "a/link", "a-b/c.txt"]
    spark.dataSource.register(git_tree.GitStateSource)
    (tmp_path / "a" / "b.txt").write_text("y")
    (tmp_path / "k.pem").write_text("k")
    run("add", "k.pem")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "k", "k.pem")
    (tmp_path / "k.pem").write_text("other")
    state = spark.read.format("git_state").option("checkouts", f"o/r={tmp_path}").load().first()
    assert not state.clean and "+y" in state.diff and "k.pem" not in state.diff and not state.truncated and len(state.revision) == 40
    assert git_tree.diff(str(tmp_path), path="a/b.txt", most=5)[1] and git_tree.diff(str(tmp_path), staged=True) == ("", False)
    with pytest.raises(ValueError):
        git_tree.diff(str(tmp_path), path="k.pem")
    assert {r.path: (r.is_regular, r.content and bytes(r.content), r.clean) for r in rows} == {"a/b.txt": (True, b"x", False), "a/link": (False, None, False), "a-b/c.txt": (True, b"1234", False)}


def test_payloads(spark):
    sha = "a" * 40
    hub = spark.createDataFrame([(json.dumps({"number": 7, "html_url": "u", "state": "open", "title": "t", "head": {"sha": sha}, "base": {"ref": "main"}, "check_runs": [{"name": "c", "status": "completed", "conclusion": "success", "html_url": "v"}]}),), ("no",)], "payload STRING")
    assert tuple(payloads.changes(hub, "github").first()) == (7, "u", "open", "t", sha, "main")
    assert [tuple(r) for r in payloads.checks(hub, "github").collect()] == [("c", "completed", "success", "v")]
    lab = spark.createDataFrame([(json.dumps([{"name": "c", "status": "success", "target_url": "v"}]),)], "payload STRING")
    assert [tuple(r) for r in payloads.checks(lab, "gitlab").collect()] == [("c", "success", None, "v")]
    tools = spark.createDataFrame([("git.diff",)], "name STRING")
    call = lambda *names, content="hi", arguments="{}": json.dumps({"choices": [{"message": {"content": content, "tool_calls": [{"function": {"name": n, "arguments": arguments}} for n in names]}}]})
    decision = '{"action": {"name": "git__diff", "arguments": {"b": 1, "a": 2}}, "plan": "p"}'
    bodies = [call("git__diff"), call("other"), call(), call("a", "b"), "no", call("git__diff", arguments="{"), call(content=decision), call(content=" "), call("git__diff", arguments="[1]"), None, call("git__diff", content=None)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id INT, body STRING")
    got = {r.id: (r.error, r.plan, r.action_name, r.arguments, r.result) for r in payloads.answers(df, tools).collect()}
    assert got == {
        0: (None, "hi", "git.diff", "{}", None), 1: (None, "hi", "other", "{}", None), 2: (None, None, None, None, "hi"), 3: ("more than one tool call", None, None, None, None), 4: ("no assistant message", None, None, None, None),
        5: ("arguments are not json", None, None, None, None), 6: (None, "p", "git.diff", '{"a":2,"b":1}', None), 7: ("neither a tool call nor content", None, None, None, None), 8: ("arguments are not an object", None, None, None, None),
        9: ("no assistant message", None, None, None, None), 10: (None, None, "git.diff", "{}", None),
    }
    one = spark.createDataFrame([(json.dumps([{"old_path": "a", "new_path": "b", "diff": "@@x"}, {"old_path": "c", "new_path": "c"}]),), ("x" * 20,)], "payload STRING")
    assert [(r.diff, r.truncated) for r in payloads.diffs(one.limit(1), "gitlab").collect()] == [("diff --git a/a b/b\n@@x\ndiff --git a/c b/c\n", False)]
    assert [(r.diff, r.truncated) for r in payloads.diffs(one, "github", most=10).collect()][1] == ("x" * 10, True)
    assert [tuple(r) for r in payloads.check_totals(lab.withColumn("k", lab.payload.substr(1, 1)), "gitlab", "k").collect()] == [("[", 1)]


def test_recorder_stream_holds_plans_across_batches(spark, tmp_path):
    rows = [(1, [message("user", "q"), message("assistant", "p", channel="plan")]), (2, [message("assistant", "p", channel="plan"), message("user", "x"), message("assistant", "d")])]
    schema = f"traj_id BIGINT, messages ARRAY<{MESSAGE}>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    more = [(1, [message("user", "q"), message("assistant", "p", channel="plan"), message("assistant", decision='{"result": "r"}')])]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = flows.stream_of(spark, f"{tmp_path}/in", files_per_trigger=1)
    out = {(r.run, r.pos): (r.plan, r.decision, r.error) for r in flows.run_available(flows.recorder(flows.message_events(stream))).collect()}
    assert out == {(1, 2): ("p", '{"result": "r"}', None), (2, 1): ("p", "x", "plan without action or result"), (2, 2): (None, "d", None)}


def test_windowed_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 700) AS ts, concat('t', id % 3) AS event_type, cast(id AS DOUBLE) AS value FROM range(500)")
    df.write.parquet(f"{tmp_path}/ev")
    got = {(r.w.start, r.event_type): (r.events, r.total) for r in flows.run_available(flows.windowed_events(flows.stream_of(spark, f"{tmp_path}/ev")), "complete").collect()}
    from pyspark.sql import functions as F

    want = {(r.w.start, r.event_type): (r.n, r.v) for r in df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()}
    assert got == want


def test_shards_on_disk(spark, tmp_path):
    from sparkloom.sources import shards

    packed = spark.createDataFrame([(0, [1, 65535, 3], [0, 1, 1]), (1, [7], [1])], "shard INT, tokens ARRAY<INT>, mask ARRAY<INT>")
    listed = shards.write_shards(packed, f"{tmp_path}/s")
    assert sorted(tuple(r) for r in listed.collect()) == [(0, 3, 2), (1, 1, 1)]
    assert sorted(tuple(r) for r in shards.read_shards(spark, f"{tmp_path}/s").collect()) == [(0, [1, 65535, 3], [0, 1, 1]), (1, [7], [1])]
    assert json.loads(shards.metadata(listed, 100))["tokens"] == 4
    with pytest.raises(ValueError):
        shards.metadata(listed, 65_537)
    raw = {r.shard: bytes(r.tokens) for r in spark.read.parquet(f"{tmp_path}/s").collect()}
    assert raw[0] == b"\x01\x00\xff\xff\x03\x00"
    with pytest.raises(Exception, match="an id is not"):
        shards.write_shards(spark.createDataFrame([(0, [65536], [1])], "shard INT, tokens ARRAY<INT>, mask ARRAY<INT>"), f"{tmp_path}/t")


def test_configuration(tmp_path):
    from sparkloom.sources import config

    (tmp_path / "p.json").write_text('{"split_salt": "s", "allowed_licenses": ["MIT"]}')
    assert config.load_policy(str(tmp_path / "p.json")).allowed_licenses == ("MIT",)
    for bad in ({"num_key_value_heads": 5}, {"vocab_size": 100_000}, {"hidden_size": 770}):
        with pytest.raises(ValueError):
            config.DecoderShape(**bad)
    assert config.Schedule().tokens_per_step == 65_536 and config.Schedule().consumed(3) == 96
    with pytest.raises(ValueError):
        config.Schedule(warmup_steps=50_000)
    (tmp_path / "policy.json").write_text('{"near_duplicate_hamming_distance": 2, "require_clean_git": false}')
    assert not config.load_policy(str(tmp_path / "policy.json")).require_clean_git
    (tmp_path / "run.json").write_text('{"sequence_length": 256, "adapter": {"rank": 4, "target_modules": ["q_proj"]}}')
    run = config.load_adapter_run(str(tmp_path / "run.json"))
    assert run.adapter.target_modules == ("q_proj",) and run.quantization.quant_type == "nf4" and config.RunSettings().validation_seed(10) == 1347
    for kind, bad in ((config.AdapterShape, {"dropout": 1.0}), (config.Quantization, {"quant_type": "int8"}), (config.AdapterRun, {"precision": "fp32"}), (config.AdapterRun, {"max_steps": 0}), (config.RunSettings, {"log_every": 0}), (config.RuntimeLimits, {"max_steps": 0})):
        with pytest.raises(ValueError):
            kind(**bad)
    (tmp_path / "host.json").write_text('{"provider": "GitLab", "repository": "o/r", "token_env": "TOKEN"}')
    assert config.load_host(str(tmp_path / "host.json")).provider == "gitlab"
    for bad in ({"provider": "gitea", "repository": "o/r", "token_env": "T"}, {"provider": "x", "repository": "o/r", "token_env": "T"}):
        with pytest.raises(ValueError):
            config.Host(**bad)
    (tmp_path / "bad.json").write_text('{"no_such": 1}')
    with pytest.raises(ValueError, match="no_such"):
        config.load_limits(str(tmp_path / "bad.json"))


def test_synthetic_conversations(spark):
    from pyspark.sql import functions as F

    from sparkloom.operators import trajectories as tr
    from sparkloom.sources import synthetic

    d = synthetic.dataset(spark, {"train": 4, "validation": 2, "eval": 1}).cache()
    assert d.count() == 70 and d.select("split", "index").distinct().groupBy("index").count().where("count > 1").isEmpty()
    assert d.select(tr.canonicalize("messages").alias("c"), tr.observation_errors(F.col("messages")).alias("e")).where("c.error IS NOT NULL OR e IS NOT NULL").isEmpty()
    from sparkloom.sources import catalog

    assert d.select(tr.generated_error(tr.canonicalize("messages")["messages"], tuple(catalog.TOOLS)).alias("e")).where("e IS NOT NULL").isEmpty()
    from sparkloom.functions.schema_rules import argument_error

    calls = d.select(F.explode(F.filter(tr.canonicalize("messages")["messages"], lambda m: m["action_name"].isNotNull())).alias("m"))
    assert calls.select(argument_error(catalog.schemas(), F.col("m.action_name"), F.col("m.arguments")).alias("e")).where("e IS NOT NULL").isEmpty()
    assert d.where(F.exists("messages", lambda m: F.contains(F.to_json(m), F.lit("§")))).isEmpty()
    assert synthetic.evaluation_cases(d).where("expected IS NULL").isEmpty() and {r.split: r["count"] for r in synthetic.smoke_records(spark).groupBy("split").count().collect()} == {"train": 6, "validation": 1}
    case = tr.with_case(d, F.col("selector"))
    assert case.where("target.role <> 'assistant' OR ordinal >= assistant_count").isEmpty() and case.count() == 70
    assert sorted(map(str, d.collect())) == sorted(map(str, synthetic.dataset(spark, {"train": 4, "validation": 2, "eval": 1}).collect()))
