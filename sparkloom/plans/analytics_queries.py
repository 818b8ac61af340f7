"""Packing, sampling, evaluation, schedules, arrays and event analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import arrays
from sparkloom.functions import text as tx
from sparkloom.operators import packing, scoring
from sparkloom.operators.lineage import cut, ensure_checkpoint_dir
from sparkloom.plans.tables import TOKENIZER_DIR, table, texts
from sparkloom.sources import jsonl, shards, sinks, synthetic

SHARD = 4096


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of tokens (here: lengths of lexical tokens), numbers outside the mask."""
    d = texts(spark, sf_dir).select("doc_id", tx.tokens("text").alias("w"))
    return d.select("doc_id", F.transform("w", lambda t: F.length(t)).alias("tokens"), F.transform("w", lambda t: F.when(t.rlike(r"^\p{Nd}+\z"), 0).otherwise(1)).alias("mask"))


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.token_totals(_streams(spark, sf_dir)).select("records", F.col("tokens").cast("bigint").alias("tokens"), F.col("supervised_tokens").cast("bigint").alias("supervised_tokens"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the one stream of all tokens, by a prefix sum in two levels."""
    rows = cut(_streams(spark, sf_dir).select("doc_id", F.size("tokens").cast("bigint").alias("size"))).where("size >= 2")
    return packing.with_offsets(rows, "doc_id", "size").select("doc_id", "size", "start")


def shard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of which document lie in which shard."""
    rows = cut(_streams(spark, sf_dir).select("doc_id", F.size("tokens").cast("bigint").alias("size")))
    s = packing.shard_slices(rows, "doc_id", "size", SHARD)
    return s.select("doc_id", F.col("shard").cast("bigint").alias("shard"), F.col("from_token").cast("bigint").alias("from_token"), F.col("to_token").cast("bigint").alias("to_token"))


def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed shards: tokens, supervised tokens and a digest of each."""
    p = packing.pack(_streams(spark, sf_dir), "doc_id", "tokens", "mask", SHARD)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return p.select(F.col("shard").cast("bigint").alias("shard"), F.size("tokens").cast("bigint").alias("tokens"), total("mask").alias("supervised"), total("tokens").alias("token_sum"), F.sha2(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ","), 256).alias("tokens_sha256"))


def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded windows over the shards, with shifted and masked labels."""
    p = cut(packing.pack(_streams(spark, sf_dir), "doc_id", "tokens", "mask", SHARD))
    w = packing.sample_windows(p, 128, 500, seed=1234)
    return w.select("index", F.col("shard").cast("bigint").alias("shard"), F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ","), 256).alias("input_sha256"), F.size(F.filter("labels", lambda x: x == packing.IGNORE)).cast("bigint").alias("ignored"))


def sampled_windows_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at choices that are given (here spread evenly over the usable starts)."""
    p = cut(packing.pack(_streams(spark, sf_dir), "doc_id", "tokens", "mask", SHARD))
    usable = p.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.size("tokens") - 128)), F.lit(0)).cast("bigint").alias("usable")).first()["usable"]
    choices = spark.range(500).select(F.col("id").alias("index"), F.pmod(F.col("id") * 7919 * 104_729, F.lit(max(1, usable))).alias("choice"))
    w = packing.sample_windows(p, 128, choices, consumed=20)
    return w.select("index", F.col("shard").cast("bigint").alias("shard"), F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ","), 256).alias("input_sha256"), F.size(F.filter("labels", lambda x: x == packing.IGNORE)).cast("bigint").alias("ignored"))


def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written to disk as flat 16-bit ids and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    p = packing.pack(_streams(spark, sf_dir), "doc_id", "tokens", "mask", SHARD)
    listed = shards.write_shards(p.select("shard", F.transform("tokens", lambda t: F.least(t, F.lit(shards.MAX_ID))).alias("tokens"), "mask"), path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    read = shards.read_shards(spark, path).select("shard", total("tokens").alias("token_sum"), total("mask").alias("mask_sum"))
    return listed.join(read, "shard").select(F.col("shard").cast("bigint").alias("shard"), F.col("token_count").cast("bigint").alias("tokens"), F.col("supervised").cast("bigint").alias("supervised"), "token_sum", "mask_sum")


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON Lines, null fields and all, read with their places and parsed again."""
    path = f"{ensure_checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    lines = jsonl.objects(jsonl.read_jsonl(spark, path), ("doc_id", "text", "lang", "source"))
    back = lines.select("error", F.from_json("value", "doc_id BIGINT, text STRING, lang STRING, source STRING").alias("r"))
    return back.select("r.doc_id", "r.lang", "r.source", F.sha2("r.text", 256).alias("text_sha256"), "error")


def counted_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal replaced in documents that hold it exactly twice."""
    d = texts(spark, sf_dir).select("doc_id", tx.replace_counted(F.col("text"), F.lit(" the "), F.lit(" THE "), F.lit(2)).alias("r"))
    return d.select("doc_id", "r.ok", F.col("r.count").cast("bigint").alias("count"), F.sha2("r.text", 256).alias("text_sha256"))


def api_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of sources as roots of a version 1 interface."""
    return table(spark, sf_dir, "sources").where("source_url IS NOT NULL").select("source_id", "source_url").distinct().select("source_id", "source_url", tx.api_root("source_url").alias("root"))


def vector_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated positions, gated values and attention over pairs of embeddings, summed up to comparable numbers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    pair = F.array(arrays.doubles("embedding"), F.reverse(arrays.doubles("embedding")))
    return e.select(
        "vec_id",
        F.round(arrays.dot(arrays.rotary("embedding", F.lit(3.0)), "embedding"), 6).alias("rotary_dot"),
        F.round(s(arrays.swiglu(F.col("embedding"), F.col("embedding"))), 6).alias("gated_sum"),
        F.round(arrays.dot(F.get(arrays.causal_attention(pair, pair, pair), F.lit(1)), "embedding"), 6).alias("attended_dot"),
    )


def synthetic_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated conversations by split and family: records, indices, selectors and decisions."""
    d = synthetic.dataset(spark, {"train": 40, "validation": 4, "eval": 4})
    turns = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    return d.groupBy("split", "family").agg(F.count("*").alias("records"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.sum("selector").alias("selectors"), F.max(turns).cast("bigint").alias("decisions"))


def shifted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir).where("size(tokens) > 0").select("doc_id", packing.shifted_labels(F.col("tokens"), F.col("mask")).alias("labels"))
    return s.select("doc_id", F.size("labels").cast("bigint").alias("labels"), F.size(F.filter("labels", lambda x: x == packing.IGNORE)).cast("bigint").alias("ignored"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"))


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of eight, padded to the longest of each."""
    s = _streams(spark, sf_dir).select("doc_id", "tokens")
    p = packing.padded(s, "doc_id", 8, {"tokens": 0})
    return p.select("doc_id", "batch", F.size("tokens").cast("bigint").alias("width"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attended"))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by a public tokenizer file."""
    d = texts(spark, sf_dir)
    return packing.encode_with(d, f"{TOKENIZER_DIR}/byte_bpe_50k.json").select("doc_id", F.size("tokens").cast("bigint").alias("tokens"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out case with the first rule it breaks."""
    e = table(spark, sf_dir, "eval_cases")
    bad = F.exists("checks", lambda c: F.coalesce(F.size(c["argv"]) <= 0, F.lit(True)) | F.exists(c["argv"], lambda a: a.isNull()))
    reason = F.coalesce(
        F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "no case id"),
        F.when(~F.coalesce(F.col("revision").rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)), "revision is not a full digest"),
        F.when(F.coalesce(F.size("checks"), F.lit(0)) <= 0, "no checks"),
        F.when(bad, "invalid check"),
        F.when(F.coalesce(F.trim("task"), F.lit("")) == "", "no task"),
    )
    return e.select("case_id", reason.alias("reason"), F.greatest(F.size("checks"), F.lit(0)).cast("bigint").alias("checks"))


def case_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by tool of their first check; a case passes if no check asks for quiet output (exit codes stand in)."""
    e = table(spark, sf_dir, "eval_cases").where("checks IS NOT NULL AND size(checks) > 0")
    r = e.select(F.col("checks")[0]["argv"][0].alias("tool"), F.when(F.length("task") % 7 == 0, "step_limit").otherwise("completed").alias("runtime_status"), F.transform("checks", lambda c: F.when(F.array_contains(c["argv"], "-q"), 1).otherwise(0)).alias("exit_codes"))
    p = scoring.pass_rate(r, "tool")
    return p.select("tool", "cases", "passed", F.round("pass_rate", 9).alias("pass_rate"))


def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as checks: purchases succeeded, errors failed, the rest were skipped."""
    ev = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("skipped").alias("conclusion"))
    out = scoring.all_passed(ev, scoring.check_passed(F.lit("completed"), F.col("conclusion")), "user_id")
    return out


def running_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good observations of each run before each of its events."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    out = scoring.running_evidence(ev, "user_id", "event_id", F.col("event_type") != "error")
    return out.select("event_id", "user_id", F.col("step").cast("bigint").alias("step"), "ok_before")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values by hour and type."""
    ev = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    out = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", "total")


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(0, 2000, 10).withColumnRenamed("id", "step")
    return r.select("step", F.round(scoring.learning_rate(F.col("step"), 3e-4, 3e-5, 100, 1500), 12).alias("rate"))


def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("small", 256, 4, 1024, 8, 2, 8192, True), ("default", 768, 12, 2560, 12, 4, 32768, True), ("untied", 768, 12, 2560, 12, 4, 32768, False)], "model STRING, h BIGINT, l BIGINT, f BIGINT, a BIGINT, k BIGINT, v BIGINT, tied BOOLEAN")
    n = scoring.parameter_count(*(F.col(c) for c in ("h", "l", "f", "a", "k", "v", "tied")))
    return m.select("model", n.alias("parameters"), F.round(n * 2 / (1 << 30), 3).alias("fp16_gib"), F.round(n * 16 / (1 << 30), 3).alias("training_gib"))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("run"), F.concat(F.lit("runs/checkpoint-"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("broken")).otherwise(F.col("o_orderkey").cast("string"))).alias("path"), (F.col("o_orderkey") % 3 > 0).alias("has_state"))


def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latest_checkpoint(_checkpoints(spark, sf_dir), "run")


def prunable_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prunable_checkpoints(_checkpoints(spark, sf_dir).select("run", "path").distinct(), 3, "run").groupBy("run").agg(F.count("*").alias("prunable"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, rotated and soft-maxed embeddings, summed up to comparable numbers."""
    e = table(spark, sf_dir, "embeddings")
    s = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return e.select("vec_id", F.round(s(arrays.rms_norm("embedding")), 6).alias("rms_sum"), F.round(arrays.dot(arrays.rotate_half("embedding"), "embedding"), 6).alias("rotated_dot"), F.round(F.array_max(arrays.softmax("embedding")), 9).alias("softmax_top"))


def vector_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy with the embedding as logits and the label as class, ignored where the label is 0; means by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.when(F.col("label") == 0, -100).otherwise(F.col("label")).alias("y"), "embedding")
    loss = e.select("label", "y", arrays.cross_entropy("embedding", F.col("y")).alias("loss"))
    return scoring.masked_mean(loss, "loss", "y", "label").select(F.col("label").cast("bigint").alias("label"), F.round("mean", 6).alias("mean_loss"))


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of line items by flag and status, over all but the last days."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price) / 1e6, 4).alias("revenue_m"), F.round(F.avg("l_discount"), 6).alias("discount"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer segment."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rank", n).where("rank <= 3").select("c_mktsegment", F.col("rank").cast("bigint").alias("rank"), "o_orderkey", F.round("o_totalprice", 2).alias("price"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_totals, token_offsets, shard_slices, packed_shards, sampled_windows, sampled_windows_given, shard_round_trip, jsonl_round_trip, counted_replacements, api_roots, vector_gates, synthetic_dataset, shifted_labels, padded_batches, encoded_documents, eval_cases,
        case_pass_rates, check_rollup, running_evidence, event_windows, learning_rates, model_sizes, latest_checkpoints, prunable_checkpoints,
        vector_norms, vector_losses, line_values, top_orders,
    )
}

_W = r"w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[^\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') AS w FROM documents WHERE text IS NOT NULL)"
_S = rf"{_W}, s AS (SELECT doc_id, [length(x) for x in w] AS tokens, [CASE WHEN regexp_full_match(x, '\p{{Nd}}+') THEN 0 ELSE 1 END for x in w] AS mask FROM w)"
_O = f"{_S}, o AS (SELECT doc_id, tokens, mask, len(tokens)::BIGINT AS size, (sum(len(tokens)) OVER (ORDER BY doc_id) - len(tokens))::BIGINT AS start FROM s WHERE len(tokens) >= 2)"
_C = "c AS (SELECT o_custkey % 50 AS run, 'runs/checkpoint-' || CASE WHEN o_orderkey % 11 = 0 THEN 'broken' ELSE o_orderkey::VARCHAR END AS path, o_orderkey % 3 > 0 AS has_state FROM orders)"

SQL = {
    "stream_totals": f"WITH {_S} SELECT count(*) AS records, sum(len(tokens))::BIGINT AS tokens, sum(coalesce(list_sum(mask), 0))::BIGINT AS supervised_tokens FROM s",
    "token_offsets": f"WITH {_O} SELECT doc_id, size, start FROM o",
    "shard_slices": f"""WITH {_O}, e AS (SELECT doc_id, size, start, unnest(range(start // {SHARD}, (start + size - 1) // {SHARD} + 1)) AS shard FROM o)
SELECT doc_id, shard, greatest(start, shard * {SHARD}) - start AS from_token, least(start + size, (shard + 1) * {SHARD}) - start AS to_token FROM e""",
    "packed_shards": f"""WITH {_O}, f AS (SELECT start + unnest(range(0, size)) AS place, unnest(tokens) AS t, unnest(mask) AS m FROM o)
SELECT place // {SHARD} AS shard, count(*) AS tokens, sum(m)::BIGINT AS supervised, sum(t)::BIGINT AS token_sum, sha256(string_agg(t::VARCHAR, ',' ORDER BY place)) AS tokens_sha256 FROM f GROUP BY ALL""",
    "shifted_labels": f"""WITH {_S}, l AS (SELECT doc_id, [CASE WHEN mask[i] = 0 THEN -100 ELSE tokens[i] END for i in range(2, len(tokens) + 1)] AS labels FROM s WHERE len(tokens) > 0)
SELECT doc_id, len(labels)::BIGINT AS labels, len([x for x in labels if x = -100])::BIGINT AS ignored, coalesce(list_sum(labels), 0)::BIGINT AS label_sum FROM l""",
    "padded_batches": f"WITH {_S}, z AS (SELECT doc_id, doc_id // 8 AS batch, len(tokens)::BIGINT AS n FROM s) SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width, n AS attended FROM z",
    "sampled_windows_given": f"""WITH {_O}, f AS (SELECT start + unnest(range(0, size)) AS place, unnest(tokens) AS t, unnest(mask) AS m FROM o),
h AS (SELECT place // {SHARD} AS shard, list(t ORDER BY place) AS t, list(m ORDER BY place) AS m FROM f GROUP BY 1), u AS (SELECT *, greatest(0, len(t) - 128) AS n FROM h), r AS (SELECT *, sum(n) OVER (ORDER BY shard) AS hi FROM u WHERE n > 0),
i AS (SELECT unnest(range(20, 500)) AS index), c AS (SELECT index, (index * 7919 * 104729) % (SELECT sum(n) FROM u) AS choice FROM i),
z AS (SELECT index, shard, t[choice - hi + n + 1:choice - hi + n + 129] AS t, m[choice - hi + n + 1:choice - hi + n + 129] AS m FROM c JOIN r ON choice >= hi - n AND choice < hi)
SELECT index, shard, sha256(array_to_string([x::VARCHAR for x in t[1:128]], ',')) AS input_sha256, len([x for x in m[2:129] if x = 0])::BIGINT AS ignored FROM z""",
    "shard_round_trip": f"""WITH {_O}, f AS (SELECT start + unnest(range(0, size)) AS place, unnest(tokens) AS t, unnest(mask) AS m FROM o)
SELECT place // {SHARD} AS shard, count(*) AS tokens, sum(m)::BIGINT AS supervised, sum(least(t, 65535))::BIGINT AS token_sum, sum(m)::BIGINT AS mask_sum FROM f GROUP BY ALL""",
    "jsonl_round_trip": "SELECT doc_id, lang, source, sha256(text) AS text_sha256, NULL::VARCHAR AS error FROM documents",
    "counted_replacements": "WITH c AS (SELECT doc_id, text, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n = 2 AS ok, n AS count, sha256(CASE WHEN n = 2 THEN replace(text, ' the ', ' THE ') ELSE text END) AS text_sha256 FROM c",
    "api_roots": "WITH u AS (SELECT DISTINCT source_id, source_url, rtrim(source_url, '/') AS r FROM sources WHERE source_url IS NOT NULL) SELECT source_id, source_url, CASE WHEN ends_with(r, '/api/v1') THEN r ELSE r || '/api/v1' END AS root FROM u",
    "vector_gates": """WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v, len(embedding) AS n, len(embedding) // 2 AS h FROM embeddings),
p AS (SELECT vec_id, v, n, list_sum([(v[i] * cos(3 / pow(10000, 2.0 * ((i - 1) % h) / n)) + (CASE WHEN i <= h THEN -v[h + i] ELSE v[i - h] END) * sin(3 / pow(10000, 2.0 * ((i - 1) % h) / n))) * v[i] for i in range(1, n + 1)]) AS rotary,
  list_sum([x / (1 + exp(-x)) * x for x in v]) AS gated, list_sum([x * x for x in v]) AS vv, list_sum([v[i] * v[n + 1 - i] for i in range(1, n + 1)]) AS vr FROM e)
SELECT vec_id, round(rotary, 6) AS rotary_dot, round(gated, 6) AS gated_sum, round((vv * exp(vr / sqrt(n)) + vr * exp(vv / sqrt(n))) / (exp(vr / sqrt(n)) + exp(vv / sqrt(n))), 6) AS attended_dot FROM p""",
    "synthetic_dataset": """WITH f(family, k, decisions) AS (VALUES ('inspect', 0, 3), ('edit_and_test', 1, 4), ('create_and_test', 2, 4), ('git_to_change', 3, 7), ('review_approve', 4, 5), ('review_block', 5, 4), ('review_merge', 6, 5), ('test_recovery', 7, 6), ('stale_write_recovery', 8, 5), ('permission_recovery', 9, 2)),
s(split, first, n) AS (VALUES ('train', 0, 40), ('validation', 10000, 4), ('eval', 20000, 4))
SELECT split, family, n::BIGINT AS records, first::BIGINT AS first_index, (first + n - 1)::BIGINT AS last_index, (n * first + n * (n - 1) // 2 + n * k)::BIGINT AS selectors, decisions::BIGINT AS decisions FROM s CROSS JOIN f""",
    "eval_cases": """SELECT case_id, CASE WHEN coalesce(trim(case_id), '') = '' THEN 'no case id' WHEN NOT coalesce(regexp_full_match(revision, '[0-9a-f]{40}'), false) THEN 'revision is not a full digest'
  WHEN coalesce(len(checks), 0) = 0 THEN 'no checks' WHEN len([c for c in checks if coalesce(len(c.argv), 0) = 0 OR len([a for a in c.argv if a IS NULL]) > 0]) > 0 THEN 'invalid check' WHEN coalesce(trim(task), '') = '' THEN 'no task' END AS reason,
  coalesce(len(checks), 0)::BIGINT AS checks FROM eval_cases""",
    "case_pass_rates": """WITH r AS (SELECT checks[1].argv[1] AS tool, length(task) % 7 <> 0 AND len([c for c in checks if list_contains(c.argv, '-q')]) = 0 AS passed FROM eval_cases WHERE len(checks) > 0)
SELECT tool, count(*) AS cases, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 9) AS pass_rate FROM r GROUP BY tool""",
    "check_rollup": "SELECT user_id, count(*) AS checks, bool_and(coalesce(event_type, '') <> 'error') AS all_passed FROM events GROUP BY user_id",
    "running_evidence": """SELECT event_id, user_id, row_number() OVER w AS step, coalesce(sum((event_type <> 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ok_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "learning_rates": """WITH r AS (SELECT unnest(range(0, 2000, 10)) AS step) SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 ELSE 3e-5 + (1 + cos(pi() * least(greatest((step - 100) / 1400.0, 0), 1))) / 2 * (3e-4 - 3e-5) END, 12)::DOUBLE AS rate FROM r""",
    "model_sizes": """WITH m(model, h, l, f, a, k, v, tied) AS (VALUES ('small', 256, 4, 1024, 8, 2, 8192, true), ('default', 768, 12, 2560, 12, 4, 32768, true), ('untied', 768, 12, 2560, 12, 4, 32768, false)),
n AS (SELECT model, ((CASE WHEN tied THEN 1 ELSE 2 END) * v * h + l * (h * a * (h // a) + 2 * h * k * (h // a) + h * h + 3 * h * f + 2 * h) + h)::BIGINT AS parameters FROM m)
SELECT model, parameters, round(parameters * 2 / 1073741824.0, 3)::DOUBLE AS fp16_gib, round(parameters * 16 / 1073741824.0, 3)::DOUBLE AS training_gib FROM n""",
    "latest_checkpoints": rf"WITH {_C}, k AS (SELECT run, path, regexp_extract(path, 'checkpoint-(\d+)$', 1) AS s FROM c WHERE has_state) SELECT run, arg_max(path, s::BIGINT) AS path, max(s::BIGINT) AS step FROM k WHERE s <> '' GROUP BY run",
    "prunable_checkpoints": f"WITH {_C}, k AS (SELECT run, path, row_number() OVER (PARTITION BY run ORDER BY path DESC) AS n FROM (SELECT DISTINCT run, path FROM c)) SELECT run, count(*) AS prunable, min(path) AS first_path, max(path) AS last_path FROM k WHERE n > 3 GROUP BY run",
    "vector_norms": """WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings), k AS (SELECT vec_id, v, len(v) // 2 AS h FROM e)
SELECT vec_id, round(list_sum(v) / sqrt(list_sum([x * x for x in v]) / len(v) + 1e-5), 6) AS rms_sum, round(list_sum([(CASE WHEN i <= h THEN -v[h + i] ELSE v[i - h] END) * v[i] for i in range(1, len(v) + 1)]), 6) AS rotated_dot,
  round(1 / list_sum([exp(x - list_max(v)) for x in v]), 9) AS softmax_top FROM k""",
    "vector_losses": """WITH e AS (SELECT label, [x::DOUBLE for x in embedding] AS v FROM embeddings), l AS (SELECT label, CASE WHEN label <> 0 THEN ln(list_sum([exp(x - list_max(v)) for x in v])) + list_max(v) - v[label + 1] END AS loss FROM e)
SELECT label::BIGINT AS label, round(coalesce(avg(loss), 0), 6) AS mean_loss FROM l GROUP BY label""",
    "line_values": """SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)) / 1e6, 4) AS revenue_m, round(avg(l_discount), 6) AS discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "top_orders": """SELECT c_mktsegment, rank, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3""",
}
