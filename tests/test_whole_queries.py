"""Queries over small tables of their own, where a cut of long rows would show."""

import re
from pathlib import Path

import psutil
from conftest import MESSAGE, message

from sparkloom.operators import corpus
from sparkloom.plans import catalogue


def test_padded_batches_keep_long_documents(spark, tmp_path):
    spark.createDataFrame([(0, "word " * 100), (1, "one two"), (8, "a b c")], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["padded_batches"](spark, str(tmp_path)).select("doc_id", "batch", "width", "attended").collect())
    assert got == [(0, 0, 100, 100), (1, 0, 100, 2), (8, 1, 3, 3)]


def test_conversation_shape_sees_late_differences(spark, tmp_path):
    texts = ["x" * 400, "x" * 399 + "y", "x" * 30_000 + "a", "x" * 30_000 + "b", "x" * 29_999 + "ya"]
    rows = [(i, "s", [message("tool", t)], None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, f"traj_id BIGINT, source_id STRING, messages ARRAY<{MESSAGE}>, metadata STRING, recorded_at TIMESTAMP").write.parquet(f"{tmp_path}/trajectories.parquet")
    got = {r.traj_id: r.observations_sha256 for r in catalogue.QUERIES["conversation_shape"](spark, str(tmp_path)).collect()}
    assert got[0] != got[1] and got[2] == got[3] != got[4]


FILE = "source_id STRING, path STRING, content STRING, is_regular BOOLEAN, scanned_at TIMESTAMP"


def test_source_digests_see_changes_in_large_files(spark, tmp_path):
    rows = [(s, "f", c, True, None) for s, c in (("a", "x" * 9000), ("b", "x" * 8999 + "y"), ("c", "x" * 1_000_001), ("d", "y" * 1_000_001))]
    spark.createDataFrame(rows, FILE).write.parquet(f"{tmp_path}/tracked_files.parquet")
    got = {r.source_id: r.digest for r in catalogue.QUERIES["source_digests"](spark, str(tmp_path)).collect()}
    assert got["a"] != got["b"] and got["c"] == got["d"]
    assert len({r.digest for r in corpus.folded_digest(spark.createDataFrame([("a", "f", "12345"), ("b", "f", "12346")], "s STRING, p STRING, c STRING"), "s", "p", "c", 4).collect()}) == 1


def test_children_lists_whole_folders(spark, tmp_path):
    spark.createDataFrame([("s", f"f{i:03}.py", "", True, None) for i in range(30)], FILE).write.parquet(f"{tmp_path}/tracked_files.parquet")
    got = catalogue.QUERIES["children"](spark, str(tmp_path)).collect()
    assert len(got) == 30 and not any(r.truncated for r in got)


def test_token_shards_keep_workers_small(spark, tmp_path):
    def write(name, rows, n):
        said = [(i, "s", [message("user", f"{name} {i} " + " ".join(f"w{i * j % 9973}" for j in range(n))), message("assistant", "done", channel="result")], None, None) for i in range(rows)]
        spark.createDataFrame(said, f"traj_id BIGINT, source_id STRING, messages ARRAY<{MESSAGE}>, metadata STRING, recorded_at TIMESTAMP").coalesce(1).write.parquet(f"{tmp_path}/{name}/trajectories.parquet")
        return lambda: catalogue.QUERIES["token_shards"](spark, f"{tmp_path}/{name}").collect()

    def memory(field):
        found = {}
        for p in psutil.Process().children(recursive=True):
            try:
                if "pyspark.daemon" in " ".join(p.cmdline()):
                    found[p.pid] = int(re.search(rf"{field}:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) // 1024
            except (psutil.Error, OSError, TypeError):
                pass
        return found

    small, large = write("small", 40, 10), write("large", 2000, 1500)
    small()
    for pid in (before := memory("VmRSS")):
        Path(f"/proc/{pid}/clear_refs").write_text("5")  # the peak begins anew
    got = sorted((r.shard, r.tokens) for r in large())
    assert got[0] == (0, 65_536) and all(n == 65_536 for _, n in got[:-1]) and len(got) > 50
    grown = {p: n - before.get(p, max(before.values())) for p, n in memory("VmHWM").items()}
    assert max(grown.values()) < 120, grown


def test_token_shards_take_one_worker_a_task(spark, tmp_path):
    said = [(i, "s", [message("user", f"go {i}"), message("assistant", "done", channel="result")], None, None) for i in range(9)]
    spark.createDataFrame(said, f"traj_id BIGINT, source_id STRING, messages ARRAY<{MESSAGE}>, metadata STRING, recorded_at TIMESTAMP").write.parquet(f"{tmp_path}/trajectories.parquet")
    plan = catalogue.QUERIES["encoded_segments"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") and not re.search("EvalPython", plan)
    assert len(catalogue.QUERIES["token_shards"](spark, str(tmp_path)).collect()) == 1
