import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import MESSAGE, message
from pyspark.sql import functions as F

from sparkloom.functions import arrays
from sparkloom.functions.schema_rules import argument_error, violations
from sparkloom.operators import packing, scoring, workspace
from sparkloom.operators import trajectories as tr
from sparkloom.plans.tables import TOKENIZER_DIR


def streams(spark, rows):
    return spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(rows)], "id BIGINT, tokens ARRAY<INT>, mask ARRAY<INT>")


def test_shards_of_a_fixed_size(spark):
    p = packing.pack(streams(spark, [([1, 2, 3, 4, 5], [0, 1, 1, 0, 1]), ([9], [1])]), "id", "tokens", "mask", 4)
    assert [tuple(r) for r in p.orderBy("shard").collect()] == [(0, [1, 2, 3, 4], [0, 1, 1, 0]), (1, [5], [1])]


def test_packing_and_windows_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(80):
        n = rng.choice([0, 1, 2, 7, 40])
        rows.append(([rng.randrange(1000) for _ in range(n)], [rng.randrange(2) for _ in range(n)]))
    flat, mask = [], []
    for t, m in rows:
        if len(t) >= 2:
            flat += t
            mask += m
    p = packing.pack(streams(spark, rows), "id", "tokens", "mask", 100)
    got = {r.shard: (r.tokens, r.mask) for r in p.collect()}
    want = {s: (flat[s * 100 : s * 100 + 100], mask[s * 100 : s * 100 + 100]) for s in range(-(-len(flat) // 100))}
    assert got == want
    w = {r["index"]: r for r in packing.sample_windows(p, 16, 40, seed=9, consumed=3).collect()}
    assert sorted(w) == list(range(3, 40))
    usable = {s: max(0, len(t) - 16) for s, (t, _) in want.items()}
    for i, r in w.items():
        c = random.Random(9 + i).randrange(sum(usable.values()))
        for s in sorted(usable):
            if c < usable[s]:
                break
            c -= usable[s]
        t, m = want[s][0][c : c + 17], want[s][1][c : c + 17]
        assert (r.shard, r.input_ids, r.labels) == (s, t[:-1], [x if y else -100 for x, y in zip(t[1:], m[1:])])
    with pytest.raises(ValueError):
        packing.sample_windows(p, 1000, 4, seed=1).collect()


def test_labels_masks_and_padding(spark):
    df = streams(spark, [([1, 2, 3], [1, 0, 1]), ([4], [1]), ([5, 6], [0, 0])])
    got = {r.id: (r.l, r.s) for r in df.select("id", packing.masked_labels(F.col("tokens"), F.col("mask")).alias("l"), packing.shifted_labels(F.col("tokens"), F.col("mask")).alias("s")).collect()}
    assert got == {0: ([1, -100, 3], [-100, 3]), 1: ([4], []), 2: ([-100, -100], [-100])}
    p = {r.id: (r.batch, r.tokens, r.attention_mask) for r in packing.padded(df, "id", 2, {"tokens": 0, "mask": 0}).collect()}
    assert p == {0: (0, [1, 2, 3], [1, 1, 1]), 1: (0, [4, 0, 0], [1, 0, 0]), 2: (1, [5, 6], [1, 1])}
    turns = spark.createDataFrame([([2, 3, 1], [False, True, True])], "n ARRAY<INT>, learns ARRAY<BOOLEAN>")
    assert turns.select(packing.span_mask(F.col("n"), F.col("learns")).alias("m")).first().m == [0, 0, 1, 1, 1, 1]
    assert turns.select(packing.span_mask(F.col("n"), F.col("learns"), "last").alias("m")).first().m == [0, 0, 0, 0, 0, 1]


def test_windows_at_given_choices(spark):
    p = spark.createDataFrame([(i, list(range(i * 100, i * 100 + 10 * (i + 1))), [1] * 10 * (i + 1)) for i in range(7)], "shard INT, tokens ARRAY<INT>, mask ARRAY<INT>")
    usable = [(i, 10 * (i + 1) - 8) for i in range(7)]
    total = sum(u for _, u in usable)
    w = {r["index"]: (r.shard, r.input_ids[0]) for r in packing.sample_windows(p, 8, spark.range(total).selectExpr("id AS index", "id AS choice")).collect()}
    want = [(i, i * 100 + k) for i, u in usable for k in range(u)]
    assert [w[i] for i in range(total)] == want


def test_records_are_encoded_segment_by_segment(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = {c: i for i, c in enumerate(["a", "b", "ab", "\n", "<|bos|>", "<|eos|>", "[U]"])}
    t = tokenizers.Tokenizer(tokenizers.models.BPE(vocabulary, [("a", "b")], unk_token="[U]"))
    t.add_special_tokens(["<|bos|>", "<|eos|>"])
    t.save(f"{tmp_path}/t.json")
    rows = [(1, None, [("a", False), ("b", True), ("ab", True)]), (2, "ab", None), (3, None, None), (4, "", [("a", True)])]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING, segments ARRAY<STRUCT<text: STRING, learns: BOOLEAN>>")
    got = {r.id: (r.tokens, r.mask) for r in packing.encode_records(df, f"{tmp_path}/t.json", "id", text="text").collect()}
    assert got == {1: ([0, 1, 2], [0, 1, 1]), 2: ([4, 3, 2, 3, 5], [1] * 5), 3: ([], []), 4: ([4, 3, 3, 5], [1] * 4)}
    with pytest.raises(Exception, match="16-bit"):
        packing.encode_records(df, f"{tmp_path}/t.json", "id", most_id=3).collect()


def test_large_batches_are_encoded_by_slices():
    sizes = []

    def encode(texts):
        sizes.append(sum(map(len, texts)))
        return [list(t.encode()) for t in texts]

    rng = random.Random(3)
    n = packing.CHUNK // 8
    word = lambda: "é" * rng.randrange(n // 2) + "x" * rng.randrange(n)
    rows = [(i, word() if i % 5 == 0 else None, None if i % 7 == 0 else [{"text": word() if rng.random() < 0.9 else None, "learns": rng.random() < 0.5} for _ in range(rng.randrange(4))]) for i in range(100)]
    rows[50] = (50, "y" * packing.CHUNK * 2, None)
    kind = pa.schema([("id", pa.int64()), ("text", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("learns", pa.bool_())])))])
    whole = pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
    got = [r for b in packing.encoded(iter([whole.slice(0, 0), whole.slice(0, 30), whole.slice(30)]), encode) for r in b.to_pylist()]
    parts = [[(f"<|bos|>\n{t}\n<|eos|>", True)] if t is not None else [(x["text"] or "", x["learns"]) for x in s or ()] for _, t, s in rows]
    assert got == [{"id": i, "tokens": [c for t, _ in p for c in t.encode()], "mask": [int(k) for t, k in p for _ in t.encode()]} for i, p in enumerate(parts)]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= packing.CHUNK + 16 * 100 and sorted(sizes)[-1] > packing.CHUNK


def test_conversations_are_encoded_as_their_segments(spark):
    pytest.importorskip("tokenizers")
    talk = [message("user", "go é"), message("assistant", "think", channel="plan"), message("assistant", action='{"name": "a\\u001b", "arguments": {"x": 1}}'), message("tool", None, "t"), message("assistant", "done", channel="result")]
    rows = [(0, talk), (1, [message("admin", "x")]), (2, []), (3, None), (4, [message("user", "é" * packing.CHUNK)]), *((i, talk * (i % 9)) for i in range(5, 300))]
    df = spark.createDataFrame(rows, f"id BIGINT, messages ARRAY<{MESSAGE}>").coalesce(1)
    file = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
    got, want = ({r.id: (r.tokens, r.mask) for r in d.collect()} for d in (packing.encode_conversations(df, file, "id"), packing.encode_records(tr.serialize(df), file, "id")))
    assert got == want and got[1] == ([], []) and sum(got[0][1]) > 10 and got[2] == got[3] != got[1]


def test_narrow_tokens_keep_the_ids(spark):
    pytest.importorskip("tokenizers")
    df = spark.createDataFrame([(i, [message("user", " ".join(map(chr, range(i * 99 + 33, i * 99 + 132)))), message("assistant", "done", channel="result")]) for i in range(40)], f"id BIGINT, messages ARRAY<{MESSAGE}>")
    file = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
    n = packing.encode_conversations(df, file, "id", narrow=True)
    assert n.schema["tokens"].dataType.simpleString() == "array<smallint>" and n.schema["mask"].dataType.simpleString() == "array<tinyint>"
    want = {r.id: (r.tokens, r.mask) for r in packing.encode_conversations(df, file, "id").collect()}
    assert {r.id: ([t & 65_535 for t in r.tokens], r.mask) for r in n.collect()} == want and max(t for x, _ in want.values() for t in x) > 32_767
    flat = lambda d: [(r.shard, [t & 65_535 for t in r.tokens], r.mask) for r in packing.pack(d, "id", "tokens", "mask", 100).orderBy("shard").collect()]
    assert flat(n) == flat(packing.encode_conversations(df, file, "id"))


def test_faster_encoding_gives_the_ids_of_the_file(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    file = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
    t = tokenizers.Tokenizer.from_file(file)
    assert packing._plain(t) is not None
    rng = random.Random(7)
    words = [*map(chr, range(128)), "<|endoftext|>", "<|", "|>", "'re", "\n\n", "    ", " the", "return", "é", "中", "\u00a0", "😀"]
    texts = ["", " " * 70_000 + "x", "a" * 70_000, " " * 60_000 + "x", *("".join(rng.choices(words, k=rng.randrange(30))) for _ in range(5000))]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in packing.encoder(file, 65_535)(texts)] == want
    t.normalizer = tokenizers.normalizers.Lowercase()
    assert packing._plain(t) is None
    t.save(f"{tmp_path}/t.json")
    assert packing.encoder(f"{tmp_path}/t.json", 65_535)(["The"]) == [t.encode("the").ids]


def test_masks_from_prefix_lengths(spark):
    df = spark.createDataFrame([([2, 3, 4, 1], [False, True, False, True], [2, 9], [5, 10], 10), ([], [], [], [], 0)], "n ARRAY<INT>, learns ARRAY<BOOLEAN>, b ARRAY<INT>, t ARRAY<INT>, size INT")
    got = df.select(packing.span_mask(F.col("n"), F.col("learns")).alias("x"), packing.prefix_mask(F.col("b"), F.col("t"), F.col("size")).alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[0].y == [0, 0, 1, 1, 1, 0, 0, 0, 0, 1]


def test_scores(spark):
    a = '{"action": {"name": "t", "arguments": {"x": 1}}}'
    rows = [(a, a), ('{"action": {"name": "t", "arguments": {"x": 2}}}', a), ('{"action": {"name": "u"}}', a), ('{"result": "ok"}', a), ('{"result": "ok"}', '{"result": "other"}'), ('{"result": " "}', '{"result": "other"}'), ("not json", a), (None, a), (a, '{"result": "x"}')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id BIGINT, raw STRING, expected STRING")
    got = {r.id: (r.valid, r.semantic, r.arguments_exact) for r in scoring.score(df).collect()}
    t, f = True, False
    assert got == {0: (t, t, t), 1: (t, t, f), 2: (t, f, f), 3: (t, f, f), 4: (t, t, t), 5: (t, f, f), 6: (f, f, f), 7: (f, f, f), 8: (t, f, f)}


def test_rates_gate_and_checks(spark):
    s = spark.createDataFrame([("base", True, True, True)] * 9 + [("base", True, False, False)] + [("adapter", True, True, False)] * 9 + [("adapter", False, False, False)], "label STRING, valid BOOLEAN, semantic BOOLEAN, arguments_exact BOOLEAN")
    assert scoring.gate(scoring.rates(s, "label"), "label", "base", "adapter").first().passed
    assert not scoring.gate(scoring.rates(s, "label"), "label", "base", "adapter", min_valid=0.95).first().passed
    assert scoring.gate(scoring.rates(s.limit(0), "label"), "label", "base", "adapter").first().passed is False
    c = spark.createDataFrame([("a", "completed", "success"), ("a", "completed", "skipped"), ("b", "queued", "success"), ("c", "success", None), ("d", None, None)], "k STRING, status STRING, conclusion STRING")
    assert {r.k: r.all_passed for r in scoring.all_passed(c, scoring.check_passed(F.col("status"), F.col("conclusion")), "k").collect()} == {"a": True, "b": False, "c": True, "d": False}
    r = spark.createDataFrame([("completed", [0, 0]), ("completed", [0, 1]), ("step_limit", [0]), ("completed", None)], "runtime_status STRING, exit_codes ARRAY<INT>")
    assert tuple(scoring.pass_rate(r).first()) == (4, 1, 0.25) and scoring.pass_rate(r.limit(0)).first().pass_rate is None


def test_checkpoints_rates_and_sizes(spark):
    p = spark.createDataFrame([("c/checkpoint-2", True), ("c/checkpoint-100", True), ("c/checkpoint-broken", True), ("c/checkpoint-200", False)], "path STRING, has_state BOOLEAN")
    assert tuple(scoring.latest_checkpoint(p).first()) == ("c/checkpoint-100", 100)
    assert {r.path for r in scoring.prunable_checkpoints(p, 2).collect()} == {"c/checkpoint-100", "c/checkpoint-2"}
    r = spark.range(0, 1501, 50).select(F.col("id"), scoring.learning_rate(F.col("id"), 1.0, 0.1, 100, 1000).alias("x")).collect()
    v = {x.id: x.x for x in r}
    assert abs(v[0] - 0.01) < 1e-12 and abs(v[100] - 1.0) < 1e-12 and abs(v[1000] - 0.1) < 1e-12 and abs(v[1500] - 0.1) < 1e-12
    m = spark.range(1).select(scoring.parameter_count(*(F.lit(x) for x in (768, 12, 2560, 12, 4, 32768)), F.lit(True)).alias("n"))
    assert m.first().n == 114_838_272


def test_arrays_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(5, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id INT, v ARRAY<DOUBLE>")
    got = df.select("id", arrays.rms_norm("v").alias("rms"), arrays.rotate_half("v").alias("rot"), arrays.softmax("v").alias("soft"), arrays.cross_entropy("v", F.lit(2)).alias("ce"), arrays.cross_entropy("v", F.lit(-100)).alias("none"), arrays.swiglu(F.col("v"), F.col("v")).alias("glu"), arrays.rotary("v", F.lit(3.0)).alias("rope")).collect()
    for r in got:
        x = rows[r.id]
        rot = np.concatenate([-x[4:], x[:4]])
        angle = np.tile(3.0 / 10_000 ** (np.arange(0, 8, 2) / 8), 2)
        soft = np.exp(x) / np.exp(x).sum()
        assert np.allclose(r.rms, x / np.sqrt((x * x).mean() + 1e-5)) and np.allclose(r.rot, rot) and np.allclose(r.soft, soft)
        assert np.isclose(r.ce, -np.log(soft[2])) and r.none is None and np.allclose(r.glu, x / (1 + np.exp(-x)) * x) and np.allclose(r.rope, x * np.cos(angle) + rot * np.sin(angle))


def test_argument_schemas(spark):
    schema = {"type": "object", "properties": {"path": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 500}, "argv": {"type": "array", "minItems": 1, "items": {"type": "string"}}, "end": {"type": ["integer", "null"]}, "mode": {"enum": ["a", "b"]}}, "required": ["path"], "additionalProperties": False}
    first = lambda v: next(violations(schema, v), None)
    assert first({"path": "x", "limit": 5, "end": None, "argv": ["a"]}) is None
    assert "wrong type" in first([]) and "lacks path" in first({}) and "unknown fields z" in first({"path": "x", "z": 1})
    assert first({"path": "x", "limit": True}) == "arguments.limit has the wrong type" and "below minimum" in first({"path": "x", "limit": 0}) and "above maximum" in first({"path": "x", "limit": 501})
    assert "below minItems" in first({"path": "x", "argv": []}) and first({"path": "x", "argv": ["a", 1]}) == "arguments.argv[1] has the wrong type" and "below minLength" in first({"path": ""}) and "allowed value" in first({"path": "x", "mode": "c"})
    df = spark.createDataFrame([(0, "t", '{"path": "x"}'), (1, "t", "{}"), (2, "u", "{}"), (3, "t", "no"), (4, "t", None)], "id INT, tool STRING, arguments STRING")
    got = {r.id: r.e for r in df.select("id", argument_error({"t": schema}, "tool", "arguments").alias("e")).collect()}
    assert got[0] is None and "lacks" in got[1] and (got[2], got[3], got[4]) == ("unknown tool", "not json", "not json")


def test_workspace(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc d\n"), (2, ""), (3, "needle\nx needle y\n")], "id INT, text STRING")
    got = {r.id: (r["slice"], r.line_count, r.end_line) for r in workspace.line_slice(df, "text", 2, 3).collect()}
    assert got == {1: ("b\nc", 4, 3), 2: ("", 0, 0), 3: ("x needle y", 2, 2)}
    assert [tuple(r) for r in workspace.search(df, "id", "text", "needle", limit=1).collect()] == [(3, 1, "needle")]
    f = spark.createDataFrame([("s", p) for p in ("a.py", "b/x.py", "b/y.py", ".env", "c.key", "b2")], "source_id STRING, path STRING")
    assert [tuple(r) for r in workspace.list_children(f, ".", "source_id").orderBy("name").collect()] == [("s", "a.py", "file", False), ("s", "b", "directory", False), ("s", "b2", "file", False)]
    assert {r.name for r in workspace.list_children(f, "b", "source_id", limit=1).collect()} == {"x.py"}
    now = spark.createDataFrame([("p", b"old")], "path STRING, content BINARY")
    import hashlib

    old = hashlib.sha256(b"old").hexdigest()
    new, late = hashlib.sha256(b"new").hexdigest(), hashlib.sha256(b"late").hexdigest()
    w = spark.createDataFrame([("p", b"late", old, 2), ("p", b"new", old, 1), ("p", b"new", "stale", 0), ("q", b"new", None, 1), ("r", b"new", old, 1), ("q", b"new", None, 1)], "path STRING, content BINARY, expected_sha256 STRING, at INT")
    got = [(r.path, r.ok, r.sha256) for r in workspace.compare_and_set(now, w, "at").collect()]
    assert sorted(got, key=str) == sorted([("p", False, new), ("p", True, new), ("p", False, new), ("q", True, new), ("q", False, new), ("r", False, None)], key=str)
    assert {r.sha256 for r in workspace.compare_and_set(now, w).where("path = 'p'").collect()} == {min(new, late)}


def test_causal_attention_equals_numpy(spark):
    rng = np.random.default_rng(3)
    q, k, v = rng.normal(size=(3, 4, 6))
    df = spark.createDataFrame([tuple([list(map(float, r)) for r in m] for m in (q, k, v))], "q ARRAY<ARRAY<DOUBLE>>, k ARRAY<ARRAY<DOUBLE>>, v ARRAY<ARRAY<DOUBLE>>")
    got = np.array(df.select(arrays.causal_attention(F.col("q"), F.col("k"), F.col("v")).alias("a")).first().a)
    s = np.where(np.tril(np.ones((4, 4))) > 0, q @ k.T / np.sqrt(6), -np.inf)
    w = np.exp(s - s.max(1, keepdims=True))
    assert np.allclose(got, w / w.sum(1, keepdims=True) @ v)
