"""Manifests, decision sources, the registry of transforms, redaction of nested values, admission by checkouts."""

import json

import pytest
from pyspark.sql import functions as F

import sparkloom
from sparkloom.functions.redaction import redact_json, redact_value
from sparkloom.operators import corpus, lineage
from sparkloom.operators.policy import CorpusPolicy
from sparkloom.sources import catalog, decisions, manifests
from sparkloom.transforms import Transforms

SHA = "a" * 40


def line(**more):
    return json.dumps({"authorized": True, "license_file": "LICENSE", "license_spdx": "MIT", "path": "/r", "source_id": "a/b", "source_url": "https://h/a/b", "revision": SHA, **more})


def test_source_manifest(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(line() + "\n\n" + line(source_id=" c/d ", authorized="true", revision="") + "\n" + line(source_id="e/f", authorized=1, revision=None))
    rows = {r.source_id: (r.authorized, r.revision, r.line) for r in manifests.source_manifest(spark, str(good)).collect()}
    assert rows == {"a/b": (True, SHA, 1), "c/d": (False, None, 3), "e/f": (False, None, 4)}
    for text, why in ((line() + "\n" + line(), ":2: duplicate source id"), (line(license_file="../x"), "unsafe"), (line(revision="abc"), "full digest"), (line(source_url=" "), "no source url"), (line(source_id=""), "no source id"), ("{}", "missing"), ("[1]", "not an object"), ("\n", "empty")):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(text)
        with pytest.raises(ValueError, match=why):
            manifests.source_manifest(spark, str(bad))
    bad.write_text(line() + "\n" + line())
    assert [r.error for r in manifests.source_manifest(spark, str(bad), strict=False).orderBy("line").collect()] == [None, "duplicate source id"]


def test_chat_rows(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"messages": [], "expected": {"result": "r"}}\n{"messages": [1], "expected": "x"}\n')
    assert [r.error for r in manifests.chat_rows(spark, str(f), strict=False, expected=True).orderBy("line").collect()] == [None, "no expected decision"]
    assert manifests.chat_rows(spark, str(f)).where("line = 2").count() == 1
    with pytest.raises(ValueError, match="x.jsonl:2"):
        manifests.chat_rows(spark, str(f), expected=True)
    f.write_text('{"messages": "no"}')
    with pytest.raises(ValueError, match="no list of messages"):
        manifests.chat_rows(spark, str(f))
    f.write_text("")
    with pytest.raises(ValueError, match="empty"):
        manifests.chat_rows(spark, str(f))


def test_scripted_decisions(spark):
    asked = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "run INT, step INT")
    script = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 0, "c")], "run INT, step INT, decision STRING")
    assert {(r.run, r.step): (r.decision, r.error) for r in decisions.scripted(asked, script).collect()} == {(1, 0): ("a", None), (1, 1): (None, "the script has ended"), (2, 0): (None, "two scripted decisions")}


def test_decision_sources_are_made_in_their_tasks(spark):
    def echo():
        def answer(requests):
            if any(m[-1]["content"] == "fail" for m in requests):
                raise RuntimeError("down")
            return [f"{len(m)}:{m[-1]['content']}" for m in requests]

        return answer

    df = spark.createDataFrame([(1, [("user", "x")]), (2, [("user", "fail")]), (3, [("user", "a"), ("user", "b")])], "id INT, turns ARRAY<STRUCT<role: STRING, content: STRING>>").coalesce(1)
    assert {r.id: (r.body, r.error) for r in decisions.decide(df, echo).collect()} == {1: ("1:x", None), 2: (None, "RuntimeError: down"), 3: ("2:b", None)}
    sent = []
    endpoint = decisions.ChatEndpoint("http://h/v1/", "m", decisions.wire_tools(catalog.schemas()), "k", send=lambda url, headers, body: sent.append((url, headers, json.loads(body))) or b"{}")
    assert endpoint([[{"role": "user", "content": "q"}]]) == ["{}"]
    url, headers, body = sent[0]
    assert url == "http://h/v1/chat/completions" and headers["Authorization"] == "Bearer k" and body["model"] == "m" and "git__diff" in {t["function"]["name"] for t in body["tools"]}


def test_transforms(spark):
    known = Transforms()
    known.register("keep", lambda df, least: df.where(F.col("id") >= least), {"least": {"type": "integer", "minimum": 0, "required": True}})
    known.register("double", lambda df: df.select((F.col("id") * 2).alias("id")), description="twice")
    with pytest.raises(ValueError, match="there already"):
        known.register("keep", lambda df: df)
    assert [t.name for t in known.specs] == ["double", "keep"]
    assert sorted(r.id for r in known.chain(spark.range(5), [("keep", {"least": 3}), ("double", {})]).collect()) == [6, 8]
    for name, arguments in (("keep", {}), ("keep", {"least": -1}), ("keep", {"least": "x"}), ("double", {"x": 1})):
        with pytest.raises(ValueError):
            known.apply(name, spark.range(1), **arguments)
    with pytest.raises(KeyError):
        known.apply("none", spark.range(1))


def test_catalogue(spark):
    rows = {r.name: (r.wire_name, json.loads(r.parameters)) for r in catalog.tool_table(spark).collect()}
    assert len(rows) == 18 and rows["git.diff"][0] == "git__diff" and rows["workspace.read"][1]["required"] == ["path"] and not any("required" in p for _, s in rows.values() for p in s["properties"].values())


def test_redaction_of_nested_values(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    deep = {"a": [key, 1, None, {"b": f"x {key} y"}], key: True}
    assert redact_value(deep) == {"a": ["<REDACTED>", 1, None, {"b": "x <REDACTED> y"}], key: True} and deep["a"][0] == key
    assert redact_value("y" * 10, most=4) == "yyyy" and redact_value("y" * 60_000, most=None) == "y" * 60_000
    nested = "x"
    for _ in range(20_000):
        nested = [nested]
    redact_value(nested)
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, f"no {key}"), (3, None), (4, "")], "id INT, t STRING")
    got = {r.id: r.r for r in df.select("id", redact_json("t").alias("r")).collect()}
    assert json.loads(got[1]) == redact_value(deep) and (got[2], got[3], got[4]) == ("no <REDACTED>", None, "")


def test_admission_by_checkouts(spark):
    cols = "source_id STRING, path STRING, source_url STRING, license_spdx STRING, license_file STRING, revision STRING, authorized BOOLEAN, listed_at TIMESTAMP_NTZ"
    s = spark.createDataFrame([(i, "/p", "u", "MIT", "LICENSE", SHA, True, None) for i in "abcd"], cols)
    f = spark.createDataFrame([(i, "LICENSE", b"MIT", True) for i in "abcd"], "source_id STRING, path STRING, content BINARY, is_regular BOOLEAN")
    now = spark.createDataFrame([("a", SHA, True), ("b", "b" * 40, True), ("c", SHA, False), ("c", SHA, False)], "source_id STRING, revision STRING, clean BOOLEAN")
    reasons = lambda policy: {r.source_id: r.reason for r in corpus.admit_sources(s, f, policy, now).collect()}
    assert reasons(CorpusPolicy()) == {"a": None, "b": "revision is not checked out", "c": "uncommitted changes", "d": "no checkout"}
    assert reasons(CorpusPolicy(require_clean_git=False))["c"] is None and "_head" not in corpus.admit_sources(s, f, CorpusPolicy(), now).columns


def test_checkpoints_off_one_machine_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())


def test_parts_are_loaded_when_asked_for():
    assert sparkloom.CorpusPolicy is CorpusPolicy and sparkloom.corpus is corpus and sparkloom.Transforms is Transforms and "packing" in dir(sparkloom)
    with pytest.raises(AttributeError):
        sparkloom.no_such_part  # noqa: B018
