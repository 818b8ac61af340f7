"""Trajectory lane: messages, decisions, segments, cases, portable chat turns, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.schema_rules import argument_error
from sparkloom.functions.text import clipped
from sparkloom.operators import packing, scoring
from sparkloom.operators import trajectories as tr
from sparkloom.operators.lineage import cut
from sparkloom.plans.tables import TOKENIZER_DIR, trajectories
from sparkloom.sources import catalog

BUDGET = 1500
INSTRUCTION = "Answer with one decision as JSON: a plan if one is needed, and either an action or a result."
#: Characters of an observation that are kept.
OBSERVATION = 30_000


def message_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trajectories(spark, sf_dir).select("source_id", F.explode("messages").alias("m"))
    return m.groupBy("source_id", "m.role", "m.channel").agg(F.count("*").alias("messages"), F.sum(F.length("m.content")).alias("chars"))


def conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: messages, assistant turns, learnt characters, clipped observations."""
    t = trajectories(spark, sf_dir)
    chars = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, m: s + F.length(F.coalesce(m["content"], m["decision"], m["action"], F.lit("")))), F.lit(0))
    turns = F.filter("messages", lambda m: m["role"] == "assistant")
    seen = F.filter("messages", lambda m: m["role"].isin("tool", "observation"))
    clip = F.transform(seen, lambda m: clipped(F.coalesce(m["content"], F.lit("")), OBSERVATION, "[...]"))
    return t.select("traj_id", F.size("messages").cast("bigint").alias("messages"), F.size(turns).cast("bigint").alias("assistant_turns"), chars(turns).alias("learnt_chars"), F.sha2(F.array_join(clip, "\x00"), 256).alias("observations_sha256"))


def canonical_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as canonical JSON; records with an error have one row that says so."""
    c = trajectories(spark, sf_dir).select("traj_id", tr.canonicalize("messages").alias("c"))
    turns = F.filter("c.messages", lambda m: m["role"] == "assistant")
    return c.select("traj_id", "c.error", F.posexplode_outer(turns).alias("nth", "m")).select("traj_id", "error", F.col("nth").cast("bigint").alias("nth"), F.when(F.col("m").isNotNull(), tr.decision_json(F.col("m"))).alias("decision"))


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical decisions of each conversation: with a plan, with an action, with a result."""
    c = trajectories(spark, sf_dir).select("traj_id", tr.canonicalize("messages").alias("c"))
    n = lambda f: F.size(F.filter("c.messages", f)).cast("bigint")
    return c.select("traj_id", n(lambda m: m["plan"].isNotNull()).alias("plans"), n(lambda m: m["action_name"].isNotNull()).alias("actions"), n(lambda m: m["result"].isNotNull()).alias("results"))


def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every conversation: role marks, sections and turn ends, with its learning flag."""
    s = tr.serialize(trajectories(spark, sf_dir))
    return s.select("traj_id", F.posexplode("segments").alias("pos", "s")).select("traj_id", F.col("pos").cast("bigint").alias("pos"), F.sha2("s.text", 256).alias("text_sha256"), F.length("s.text").cast("bigint").alias("chars"), "s.learns")


def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and learnt segments of each conversation."""
    s = tr.serialize(trajectories(spark, sf_dir))
    return s.select("traj_id", F.size("segments").cast("bigint").alias("segments"), F.size(F.filter("segments", lambda x: x["learns"])).cast("bigint").alias("learnt"))


def observation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trajectories(spark, sf_dir)
    return t.select("traj_id", tr.observation_errors(F.col("messages")).alias("error"))


def next_decision_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prefix and target for each conversation, chosen by its id."""
    c = tr.with_case(trajectories(spark, sf_dir), F.col("traj_id"))
    return c.select("traj_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("assistant_count").cast("bigint").alias("assistant_count"), F.size("prefix").cast("bigint").alias("prefix_messages"), F.coalesce("target.decision", "target.action", "target.content").alias("target"))


def _turns(df: DataFrame, turns) -> DataFrame:
    t = df.select("traj_id", F.posexplode(turns).alias("pos", "m"))
    return t.select("traj_id", F.col("pos").cast("bigint").alias("pos"), "m.role", F.sha2("m.content", 256).alias("content_sha256"))


def portable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns for training: canonical decisions as assistant turns, observations as user turns."""
    return _turns(tr.chat_turns(trajectories(spark, sf_dir)), F.col("turns"))


def request_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns for a model endpoint, behind an instruction."""
    return _turns(trajectories(spark, sf_dir), tr.request_turns(F.col("messages"), INSTRUCTION))


def context_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that stay within a budget of characters, with a notice where some were left out."""
    size = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))).cast("bigint"))
    return _turns(trajectories(spark, sf_dir), tr.context(F.col("messages"), size, BUDGET))


def generated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule for generated conversations that each one breaks."""
    c = trajectories(spark, sf_dir).select("traj_id", tr.canonicalize("messages").alias("c"))
    return c.select("traj_id", F.coalesce("c.error", tr.generated_error(F.col("c.messages"), tuple(catalog.TOOLS))).alias("error"))


def argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First violation of its tool's schema by the arguments of every action."""
    c = trajectories(spark, sf_dir).select("traj_id", F.posexplode(F.filter(tr.canonicalize("messages")["messages"], lambda m: m["action_name"].isNotNull())).alias("nth", "m"))
    return c.select("traj_id", F.col("nth").cast("bigint").alias("nth"), F.col("m.action_name").alias("tool"), argument_error(catalog.schemas(), F.col("m.action_name"), F.col("m.arguments")).alias("violation"))


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each conversation that a tokenizer would be fitted on."""
    s = tr.serialize(trajectories(spark, sf_dir)).select("traj_id", tr.training_text(F.lit(None).cast("string"), F.col("segments")).alias("t"))
    return s.select("traj_id", F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("text_sha256"))


def _encoded(spark: SparkSession, sf_dir: str, narrow: bool = False) -> DataFrame:
    return packing.encode_conversations(trajectories(spark, sf_dir), f"{TOKENIZER_DIR}/byte_bpe_50k.json", "traj_id", narrow=narrow)


def encoded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each conversation by a public tokenizer file, segment by segment, with the mask of learnt tokens."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _encoded(spark, sf_dir).select("traj_id", F.size("tokens").cast("bigint").alias("tokens"), total("mask").alias("supervised"), F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("tokens_sha256"))


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations from text to packed shards of real ids, as 16-bit numbers."""
    p = packing.pack(cut(_encoded(spark, sf_dir, narrow=True)), "traj_id", "tokens", "mask", 65_536)
    return p.select(F.col("shard").cast("bigint").alias("shard"), F.size("tokens").cast("bigint").alias("tokens"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("supervised"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that stay within a budget of characters: the first two and the longest fitting run of last ones."""
    size = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))).cast("bigint"))
    t = trajectories(spark, sf_dir).select("traj_id", F.size("messages").cast("bigint").alias("messages"), tr.within_budget(size, BUDGET).alias("_k"))
    return t.select("traj_id", "messages", F.size("_k").cast("bigint").alias("kept"), F.array_max(F.filter(F.sequence(F.lit(0), F.col("messages").cast("int") - 1), lambda i: ~F.array_contains("_k", i))).cast("bigint").alias("last_dropped"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, families and index ranges of each dataset."""
    t = trajectories(spark, sf_dir).select("metadata.*")
    return t.groupBy("dataset").agg(F.count("*").alias("records"), F.countDistinct("family").alias("families"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each canonical decision as expected, the next one of the same conversation as the output that is scored."""
    t = trajectories(spark, sf_dir).select("traj_id", "metadata.family", F.filter("messages", lambda m: m["decision"].isNotNull()).alias("d"))
    pairs = t.where(F.size("d") > 1).select("traj_id", "family", F.posexplode(F.slice("d", F.lit(1), F.size("d") - 1)).alias("i", "m"), "d")
    return pairs.select("traj_id", "family", F.col("i").cast("bigint").alias("nth"), F.col("m.decision").alias("expected"), F.get("d", F.col("i") + 1)["decision"].alias("raw"))


def decision_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_scored(spark, sf_dir)).select("traj_id", "nth", "valid", "semantic", "arguments_exact")


def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.rates(scoring.score(_scored(spark, sf_dir)), "family")
    return r.select("family", "cases", *[F.round(c, 9).alias(c) for c in ("valid_rate", "semantic_rate", "arguments_exact_rate")])


def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd conversations as the base, even ones as the adapter."""
    s = scoring.score(_scored(spark, sf_dir)).withColumn("label", F.when(F.col("traj_id") % 2 == 0, "adapter").otherwise("base"))
    return scoring.gate(scoring.rates(s, "label"), "label", "base", "adapter")


QUERIES = {
    f.__name__: f
    for f in (
        message_roles, conversation_shape, canonical_decisions, decision_counts, serialized, segment_flags, observation_checks, next_decision_cases,
        portable_turns, request_turns, context_turns, generated_checks, argument_checks, training_texts, encoded_segments, token_shards, context_budget, dataset_manifest, decision_scores, decision_rates, publication_gate,
    )
}

_T = "t AS (SELECT traj_id, any_value(source_id) AS source_id, any_value(messages) AS messages, any_value(metadata) AS metadata FROM trajectories GROUP BY traj_id)"
_M = f"{_T}, m AS (SELECT traj_id, source_id, unnest(range(0, len(messages))) AS i, unnest(messages) AS m FROM t)"
_A = f"{_M}, a AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS nth, count(*) OVER (PARTITION BY traj_id) AS n FROM m WHERE m.role = 'assistant')"
_NAME = "coalesce(json_extract_string(m.action, '$.name'), json_extract_string(m.decision, '$.action.name'))"
_SCORED = f"""{_M}, d AS (SELECT traj_id, i, m.decision AS e, lead(m.decision) OVER (PARTITION BY traj_id ORDER BY i) AS raw, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS nth FROM m WHERE m.decision IS NOT NULL),
x AS (SELECT traj_id, nth, true AS valid, CASE WHEN json_exists(e, '$.action') THEN coalesce(json_extract_string(e, '$.action.name') = json_extract_string(raw, '$.action.name'), false) ELSE coalesce(trim(json_extract_string(raw, '$.result')) <> '', false) END AS semantic,
  CASE WHEN json_exists(e, '$.action') THEN coalesce(json_extract(e, '$.action.arguments')::VARCHAR = json_extract(raw, '$.action.arguments')::VARCHAR, false) ELSE true END AS same FROM d WHERE raw IS NOT NULL),
s AS (SELECT traj_id, nth, valid, semantic, semantic AND same AS arguments_exact FROM x)"""

# Conversations without errors only: then a plan always belongs to the next message.
_CANONICAL = f"""{_M}, n AS (SELECT *, CASE WHEN lag(m.channel) OVER w = 'plan' THEN coalesce(lag(m.content) OVER w, '') END AS before FROM m WINDOW w AS (PARTITION BY traj_id ORDER BY i)),
b AS (SELECT traj_id, i, m, coalesce(before, json_extract_string(m.decision, '$.plan')) AS plan,
  CASE WHEN m.action IS NOT NULL THEN json(m.action)::VARCHAR ELSE json_extract(m.decision, '$.action')::VARCHAR END AS a,
  CASE WHEN m.decision IS NOT NULL THEN json_extract_string(m.decision, '$.result') WHEN m.action IS NULL THEN coalesce(m.content, '') END AS r FROM n WHERE NOT coalesce(m.role = 'assistant' AND m.channel = 'plan', false)),
c AS (SELECT *, '{{' || concat_ws(',', '"action":' || a, '"plan":' || to_json(plan)::VARCHAR, CASE WHEN a IS NULL THEN '"result":' || to_json(r)::VARCHAR END) || '}}' AS d FROM b)"""

_SEGMENTS = """x AS (SELECT traj_id, i, m.role = 'assistant' AS learns, CASE m.role WHEN 'system' THEN '<|system|>' WHEN 'user' THEN '<|user|>' WHEN 'assistant' THEN '<|assistant|>' ELSE '<|observation|>' END || chr(10)
  || CASE WHEN m.role = 'assistant' THEN coalesce('<|plan|>' || chr(10) || plan || chr(10), '') || coalesce('<|action|>' || chr(10) || a, '<|result|>' || chr(10) || r)
     WHEN m.role IN ('tool', 'observation') THEN 'name=' || coalesce(m.name, 'environment') || chr(10) || coalesce(m.content, '') ELSE coalesce(m.content, '') END || chr(10) || '<|turn_end|>' || chr(10) AS text FROM c),
y AS (SELECT traj_id, i, learns, text FROM x UNION ALL SELECT traj_id, -1, false, '<|bos|>' FROM t UNION ALL SELECT traj_id, 1000000, false, '<|eos|>' FROM t)"""

SQL = {
    "message_roles": f"WITH {_M} SELECT source_id, m.role AS role, m.channel AS channel, count(*) AS messages, sum(length(m.content))::BIGINT AS chars FROM m GROUP BY ALL",
    "conversation_shape": f"""WITH {_M} SELECT traj_id, count(*) AS messages, count(*) FILTER (m.role = 'assistant') AS assistant_turns,
  coalesce(sum(length(coalesce(m.content, m.decision, m.action, ''))) FILTER (m.role = 'assistant'), 0)::BIGINT AS learnt_chars,
  sha256(coalesce(string_agg(CASE WHEN length(m.content) > {OBSERVATION} THEN m.content[1:{OBSERVATION}] || '[...]' ELSE coalesce(m.content, '') END, chr(0) ORDER BY i) FILTER (m.role IN ('tool', 'observation')), '')) AS observations_sha256 FROM m GROUP BY traj_id""",
    "decision_counts": f"""WITH {_M} SELECT traj_id, count(*) FILTER (m.role = 'assistant' AND (m.channel = 'plan' OR json_exists(m.decision, '$.plan'))) AS plans,
  count(*) FILTER (m.role = 'assistant' AND (m.action IS NOT NULL OR json_exists(m.decision, '$.action'))) AS actions,
  count(*) FILTER (m.role = 'assistant' AND (m.channel = 'result' OR json_exists(m.decision, '$.result') OR (m.channel IS NULL AND m.action IS NULL AND m.decision IS NULL))) AS results FROM m GROUP BY traj_id""",
    "canonical_decisions": f"""WITH {_CANONICAL} SELECT traj_id, NULL::VARCHAR AS error, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS nth, d AS decision FROM c WHERE m.role = 'assistant'""",
    "serialized": f"""WITH {_CANONICAL}, {_SEGMENTS}
SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS pos, sha256(text) AS text_sha256, length(text) AS chars, learns FROM y""",
    "training_texts": f"""WITH {_CANONICAL}, {_SEGMENTS} SELECT traj_id, sum(length(text))::BIGINT AS chars, sha256(string_agg(text, '' ORDER BY i)) AS text_sha256 FROM y GROUP BY traj_id""",
    "segment_flags": f"""WITH {_M} SELECT traj_id, 2 + count(*) FILTER (NOT coalesce(m.channel = 'plan', false)) AS segments, count(*) FILTER (m.role = 'assistant' AND NOT coalesce(m.channel = 'plan', false)) AS learnt FROM m GROUP BY traj_id""",
    "observation_checks": f"""WITH {_M}, u AS (SELECT traj_id, i, m.role AS role, m.name AS name, lag(m.role) OVER w AS before, lag({_NAME}) OVER w AS action FROM m WHERE m.role IN ('assistant', 'tool') WINDOW w AS (PARTITION BY traj_id ORDER BY i)),
e AS (SELECT traj_id, bool_or(role = 'tool' AND NOT coalesce(before = 'assistant' AND action = name, false)) AS wrong, bool_or(role = 'assistant') AS decided FROM u GROUP BY traj_id)
SELECT t.traj_id, CASE WHEN wrong THEN 'observation does not match the action' WHEN NOT coalesce(decided, false) THEN 'no decision' END AS error FROM t LEFT JOIN e USING (traj_id)""",
    "next_decision_cases": f"WITH {_A} SELECT traj_id, nth AS ordinal, n AS assistant_count, i AS prefix_messages, coalesce(m.decision, m.action, m.content) AS target FROM a WHERE nth = traj_id % n",
    "portable_turns": f"""WITH {_CANONICAL} SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS pos, CASE WHEN m.role IN ('tool', 'observation') THEN 'user' ELSE m.role END AS role,
  sha256(CASE WHEN m.role = 'assistant' THEN d WHEN m.role IN ('tool', 'observation') THEN 'OBSERVATION[' || coalesce(m.name, 'environment') || ']' || chr(10) || coalesce(m.content, '') ELSE coalesce(m.content, '') END) AS content_sha256 FROM c""",
    "request_turns": f"""WITH {_M}, k AS (SELECT traj_id, i, CASE WHEN m.role = 'tool' THEN 'user' ELSE m.role END AS role,
  CASE WHEN m.role = 'tool' THEN 'OBSERVATION[' || coalesce(m.name, 'tool') || ']' || chr(10) || coalesce(m.content, '') ELSE coalesce(m.content, m.decision, m.action, '') END AS content FROM m WHERE m.role IN ('system', 'user', 'assistant', 'tool')
  UNION ALL SELECT traj_id, -1, 'system', '{INSTRUCTION}' FROM t) SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS pos, role, sha256(content) AS content_sha256 FROM k""",
    "context_turns": f"""WITH {_M}, z AS (SELECT traj_id, i, m, length(coalesce(m.content, '')) AS n FROM m),
w AS (SELECT traj_id, i, m, sum(n) OVER (PARTITION BY traj_id) AS total, sum(CASE WHEN i < 2 THEN n ELSE 0 END) OVER (PARTITION BY traj_id) AS head, sum(n) OVER (PARTITION BY traj_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM z),
k AS (SELECT traj_id, i::DOUBLE AS i, m.role AS role, coalesce(m.content, '') AS content FROM w WHERE total <= {BUDGET} OR i < 2 OR tail <= {BUDGET} - head UNION ALL SELECT DISTINCT traj_id, 1.5, 'system', '{tr.NOTICE}' FROM w WHERE total > {BUDGET} AND i >= 2 AND tail > {BUDGET} - head)
SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS pos, role, sha256(content) AS content_sha256 FROM k""",
    "generated_checks": f"""WITH {_CANONICAL}, u AS (SELECT traj_id, i, m.role AS role, m.name AS name, m.content AS content, json_extract_string(a, '$.name') AS action FROM c WHERE m.role IS NULL OR m.role NOT IN ('system', 'user')),
v AS (SELECT *, lag(role) OVER w AS before, lag(action) OVER w AS asked FROM u WINDOW w AS (PARTITION BY traj_id ORDER BY i)),
e AS (SELECT traj_id, i, CASE WHEN role = 'assistant' AND action NOT IN ({", ".join(f"'{x}'" for x in catalog.TOOLS)}) THEN 'unknown action' WHEN role = 'tool' AND NOT coalesce(before = 'assistant' AND asked IS NOT DISTINCT FROM name, false) THEN 'observation does not match the action'
  WHEN role = 'tool' AND NOT json_valid(coalesce(content, '')) THEN 'observation is not json' WHEN coalesce(role, '') NOT IN ('assistant', 'tool') THEN 'unsupported role' END AS error FROM v),
f AS (SELECT traj_id, arg_min(error, i) FILTER (error IS NOT NULL) AS error FROM e GROUP BY traj_id), g AS (SELECT DISTINCT traj_id FROM u WHERE role = 'assistant')
SELECT t.traj_id, coalesce(f.error, CASE WHEN g.traj_id IS NULL THEN 'no decision' END) AS error FROM t LEFT JOIN f USING (traj_id) LEFT JOIN g USING (traj_id)""",
    "argument_checks": f"""WITH {_CANONICAL}, s(tool, required, known, top) AS (VALUES {", ".join(f"('{n}', {[k for k, v in x.items() if v.get('required')]}::VARCHAR[], {sorted(x)}::VARCHAR[], {x.get('limit', {}).get('maximum', 'NULL')})" for n, x in catalog.TOOLS.items())}),
q AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS nth, json_extract_string(a, '$.name') AS tool, json_extract(a, '$.arguments') AS g FROM c WHERE a IS NOT NULL),
r AS (SELECT q.*, required, known, top, [x for x in required if NOT list_contains(json_keys(g), x)] AS missing, list_sort([x for x in json_keys(g) if NOT list_contains(known, x)]) AS extra FROM q LEFT JOIN s USING (tool))
SELECT traj_id, nth, tool, CASE WHEN known IS NULL THEN 'unknown tool' WHEN len(missing) > 0 THEN 'arguments lacks ' || missing[1] WHEN len(extra) > 0 THEN 'arguments has unknown fields ' || array_to_string(extra, ', ')
  WHEN json_extract(g, '$.limit')::INT > top THEN 'arguments.limit is above maximum ' || top END AS violation FROM r""",
    "context_budget": f"""WITH {_M}, z AS (SELECT traj_id, i, length(coalesce(m.content, '')) AS n FROM m),
w AS (SELECT traj_id, i, sum(n) OVER (PARTITION BY traj_id) AS total, sum(CASE WHEN i < 2 THEN n ELSE 0 END) OVER (PARTITION BY traj_id) AS head, sum(n) OVER (PARTITION BY traj_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM z),
k AS (SELECT traj_id, i, total <= {BUDGET} OR i < 2 OR tail <= {BUDGET} - head AS kept FROM w)
SELECT traj_id, count(*) AS messages, count(*) FILTER (kept) AS kept, max(i) FILTER (NOT kept) AS last_dropped FROM k GROUP BY traj_id""",
    "dataset_manifest": f"""WITH {_T} SELECT metadata.dataset AS dataset, count(*) AS records, count(DISTINCT metadata.family) AS families, min(metadata.index) AS first_index, max(metadata.index) AS last_index,
  coalesce(string_agg(DISTINCT metadata.license, ',' ORDER BY metadata.license), '') AS licenses FROM t GROUP BY metadata.dataset""",
    "decision_scores": f"WITH {_SCORED} SELECT * FROM s",
    "decision_rates": f"""WITH {_SCORED} SELECT t.metadata.family AS family, count(*) AS cases, round(avg(valid::INT), 9) AS valid_rate, round(avg(semantic::INT), 9) AS semantic_rate, round(avg(arguments_exact::INT), 9) AS arguments_exact_rate
FROM s JOIN t USING (traj_id) GROUP BY t.metadata.family""",
    "publication_gate": f"""WITH {_SCORED}, r AS (SELECT avg(valid::INT) FILTER (traj_id % 2 = 0) AS v, avg(semantic::INT) FILTER (traj_id % 2 = 0) AS s, avg(semantic::INT) FILTER (traj_id % 2 = 1) AS b FROM s)
SELECT v >= 0.9 AS valid_ok, s >= 0.8 AS semantic_ok, s >= b - 0.05 AS not_worse, coalesce(v >= 0.9 AND s >= 0.8 AND s >= b - 0.05, false) AS passed FROM r""",
}
