"""Corpus lane: admission, paths, normalization, fingerprints, duplicates, splits, builds, reading of trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fingerprints, paths
from sparkloom.functions import text as tx
from sparkloom.operators import corpus, workspace
from sparkloom.operators.lineage import cut, ensure_checkpoint_dir
from sparkloom.operators.policy import CorpusPolicy
from sparkloom.plans.tables import files, spread, table, texts
from sparkloom.sources import sinks

POLICY = CorpusPolicy()
RATIO = CorpusPolicy(validation_fraction=0.1)


def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.admit_sources(table(spark, sf_dir, "sources"), table(spark, sf_dir, "tracked_files"), POLICY)
    return out.select("source_id", "license_spdx", "revision", "reason")


def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_sources(table(spark, sf_dir, "sources"), RATIO)


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "tracked_files").select("source_id", "path").distinct()
    ok = paths.allowed("path", POLICY.allowed_extensions, POLICY.allowed_filenames, POLICY.excluded_globs)
    return f.select("source_id", "path", ok.alias("allowed"), F.lower(paths.suffix("path")).alias("suffix"), paths.is_sensitive("path").alias("sensitive"), paths.is_unsafe("path").alias("unsafe"))


def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.normalize_files(files(spark, sf_dir), POLICY)
    return out.select("source_id", "path", "reason", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("sha256"))


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.strip(tx.unix_lines("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("chars"), tx.content_sha256(F.concat("t", F.lit("\n"))).alias("sha256"), F.coalesce(F.when(F.length("t") < 32, "file_too_short"), F.concat(F.lit("sensitive:"), tx.sensitive_reason("t"))).alias("reason"))


def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = cut(normalized_files(spark, sf_dir).select("reason"))  # else the filter on it repeats the work
    return reasons.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("files"))


def corpus_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected files by split and reason, without the near-duplicate step."""
    audit = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO, near=False)["audit"]
    return audit.groupBy("decision", "reason", "split").agg(F.count("*").alias("files"))


def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file of the admitted sources, with near duplicates."""
    return corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO)["audit"]


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO)["records"]
    return r.select("metadata.source_id", "metadata.path", "metadata.split", "metadata.license_spdx", "metadata.sha256", F.length("text").cast("bigint").alias("chars"))


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO)["manifest"]
    return m.select("format_version", "policy_sha256", "counts.accepted", "counts.rejected", "counts.train", "counts.validation", F.to_json("rejection_reasons").alias("rejection_reasons"), F.size("sources").alias("sources"))


def corpus_audit_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit with fingerprints over SHA-256, which SQL can compute."""
    return corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO, native=True)["audit"]


def corpus_records_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a build without the near-duplicate step."""
    r = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO, near=False)["records"]
    return r.select("metadata.source_id", "metadata.path", "metadata.split", "metadata.license_spdx", "metadata.sha256", F.length("text").cast("bigint").alias("chars"))


def corpus_manifest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a build without the near-duplicate step."""
    m = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO, near=False)["manifest"]
    return m.select("policy_sha256", "counts.accepted", "counts.rejected", "counts.train", "counts.validation", F.to_json("rejection_reasons").alias("rejection_reasons"), F.size("sources").cast("bigint").alias("sources"))


def published_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build published to a folder at once and read back: records of each split, and audit lines."""
    frames = corpus.build(table(spark, sf_dir, "sources"), spread(table(spark, sf_dir, "tracked_files")), RATIO, near=False)
    path = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.publish(frames, path)
    records = spark.read.option("basePath", f"{path}/records").text(f"{path}/records").groupBy(F.concat(F.lit("records:"), "split").alias("part")).agg(F.count("*").alias("lines"))
    return records.union(spark.read.text(f"{path}/audit").agg(F.count("*").alias("lines")).select(F.lit("audit").alias("part"), "lines"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(texts(spark, sf_dir).select("doc_id", tx.content_sha256(tx.strip(tx.unix_lines("text"))).alias("sha256")))
    out = corpus.with_firsts(d, "sha256", F.struct(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "f", "doc_id").where("f IS NOT NULL")
    return out.select("doc_id", "f.first_id", "f.copies", (F.col("doc_id") == F.col("f.first_id")).alias("kept"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    words = tx.masked_tokens("text")
    return d.select("doc_id", F.size(words).cast("bigint").alias("tokens"), F.size(F.filter(words, lambda t: t == tx.NUMBER_MARK)).cast("bigint").alias("numbers"), F.sha2(F.array_join(words, "\x00"), 256).alias("tokens_sha256"))


def top_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles that most documents hold."""
    d = texts(spark, sf_dir)
    each = d.select("doc_id", F.explode(F.array_distinct(tx.token_shingles(tx.masked_tokens("text"), most=1 << 30))).alias("s"))
    return each.groupBy("s").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "s").limit(50).select(F.replace("s", F.lit("\x00"), F.lit(" ")).alias("shingle"), "documents")


def simhash_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.simhash_native(texts(spark, sf_dir), "doc_id", "text")


def simhash_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", fingerprints.simhash("text").alias("simhash"))


def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each bucket of each 16-bit band."""
    h = simhash_native(spark, sf_dir).select(F.posexplode(fingerprints.bands("simhash")).alias("band", "bucket"))
    return h.groupBy(F.col("band").cast("bigint").alias("band"), "bucket").agg(F.count("*").alias("documents"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct fingerprints within distance 3, with the documents of each."""
    prints = cut(simhash_native(spark, sf_dir))
    pairs = corpus.near_pairs(prints.select("simhash").distinct(), 3)
    n = prints.groupBy("simhash").agg(F.count("*").alias("n"))
    out = pairs.join(n.withColumnsRenamed({"simhash": "lo", "n": "documents_lo"}), "lo").join(n.withColumnsRenamed({"simhash": "hi", "n": "documents_hi"}), "hi")
    return out.select("lo", "hi", F.col("distance").cast("bigint").alias("distance"), "documents_lo", "documents_hi")


def near_duplicate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that it duplicates, in order of doc_id."""
    return _greedy(cut(texts(spark, sf_dir).select("doc_id", fingerprints.simhash("text").alias("simhash"))))


def near_duplicate_greedy_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by fingerprints over SHA-256."""
    return _greedy(cut(simhash_native(spark, sf_dir)))


def _greedy(prints: DataFrame) -> DataFrame:
    heads = prints.groupBy("simhash").agg(F.min("doc_id").alias("rank"))
    gone = corpus.greedy_keep(heads, corpus.near_pairs(heads.select("simhash"), 3))
    keeper = gone.join(heads.withColumnsRenamed({"simhash": "keeper", "rank": "of"}), "keeper").select("simhash", "of")
    out = prints.join(heads, "simhash").join(keeper, "simhash", "left")
    return out.select("doc_id", F.coalesce("of", F.when(F.col("doc_id") != F.col("rank"), F.col("rank"))).alias("duplicate_of"))


def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    return workspace.search(d, "doc_id", "text", r"(?:ERROR|FAILED) [a-z]+_[a-z]+", regex=True).select("doc_id", F.col("line").cast("bigint").alias("line"), "text")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "tracked_files").select("source_id", "path").distinct()
    return workspace.list_children(f, ".", "source_id")


def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", tx.unix_lines("text").alias("text"))
    out = workspace.line_slice(d, "text", 2, 4)
    return out.select("doc_id", F.col("line_count").cast("bigint").alias("line_count"), F.col("end_line").cast("bigint").alias("end_line"), F.sha2("slice", 256).alias("slice_sha256"), "sha256")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    return d.select("doc_id", F.sha2(tx.redact_address(tx.redact("text")), 256).alias("redacted_sha256"))


def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored digests of license files against those of the contents."""
    r = table(spark, sf_dir, "resolved_sources").where("license_sha256 IS NOT NULL").select("source_id", "license_sha256").distinct()
    f = table(spark, sf_dir, "tracked_files").where("is_regular").select("source_id", F.col("path").alias("license_file"), F.sha2("content", 256).alias("now")).distinct()
    s = table(spark, sf_dir, "sources").select("source_id", "license_file").distinct()
    return r.join(s, "source_id").join(f, ["source_id", "license_file"], "left").select("source_id", "license_file", F.col("now").eqNullSafe(F.col("license_sha256")).alias("unchanged"))


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all regular files of each source."""
    return corpus.folded_digest(files(spark, sf_dir).where("is_regular AND content IS NOT NULL"), "source_id", "path", "content")


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners whose sources are in more than one split."""
    r = table(spark, sf_dir, "resolved_sources").select(F.lower(F.substring_index("source_id", "/", 1)).alias("owner"), F.nullif(F.lower(F.trim("split")), F.lit("")).alias("split"))
    return corpus.split_overlap(r.where("split IS NOT NULL"), "owner")


QUERIES = {
    f.__name__: f
    for f in (
        source_admission, source_split, path_filter, normalized_files, normalized_documents, rejection_histogram, corpus_decisions, corpus_audit,
        corpus_records, corpus_manifest, corpus_audit_native, corpus_records_exact, corpus_manifest_exact, published_corpus, near_duplicate_greedy_native, exact_duplicates, token_counts, top_shingles, simhash_native, simhash_blake, simhash_bands, near_duplicate_pairs,
        near_duplicate_greedy, line_search, children, line_slices, redacted_documents, license_digests, source_digests, split_overlaps,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _unix(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


_EXCLUDED = "regexp_matches(path, '^(?:" + "|".join(p.replace(".", "\\.").replace("*", "§").replace("§§", "[\\s\\S]*").replace("§", "[\\s\\S]*") for g in POLICY.excluded_globs for p in (g, g[3:])) + ")$')"
_ALLOWED = f"(NOT {_EXCLUDED} AND ({_NAME} IN ({_quoted(POLICY.allowed_filenames)}) OR {_SUFFIX} IN ({_quoted(POLICY.allowed_extensions)})))"
_UNSAFE = "(starts_with(path, '/') OR list_contains(string_split(path, '/'), '..'))"


def _sensitive(x: str) -> str:
    """First pattern; looking around is not needed to decide whether an address is there."""
    rules = {**tx.SENSITIVE, "email_address": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}"}
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN 'sensitive:{n}'" for n, p in rules.items()) + " END"


_FILES = "SELECT source_id, path, arg_max_null(content, seen) AS content, arg_max_null(is_regular, seen) AS is_regular FROM (SELECT *, coalesce(scanned_at, TIMESTAMP '1900-01-01') AS seen FROM tracked_files) GROUP BY source_id, path"
_NORMALIZED = f"""
WITH f AS ({_FILES}),
a AS (SELECT source_id, path, content, CASE WHEN NOT {_ALLOWED} THEN 'path_filtered' WHEN NOT coalesce(is_regular, false) OR content IS NULL THEN 'not_regular_file'
  WHEN octet_length(content) > {POLICY.max_file_bytes} THEN 'file_too_large' WHEN regexp_matches(hex(content), '^(..)*00') THEN 'binary_file'
  WHEN TRY(decode(content)) IS NULL THEN 'invalid_utf8' END AS why FROM f),
b AS (SELECT source_id, path, why, CASE WHEN why IS NULL THEN {_strip(_unix("TRY(decode(content))"))} END AS t FROM a),
n AS (SELECT source_id, path, t, coalesce(why, CASE WHEN length(t) < {POLICY.min_file_chars} THEN 'file_too_short' END, {_sensitive("t")}) AS reason FROM b)
"""
_ADMITTED = f"""
one AS (SELECT source_id, arg_max_null(license_spdx, listed_at) AS license_spdx, arg_max_null(license_file, listed_at) AS license_file, arg_max_null(revision, listed_at) AS revision,
  arg_max_null(authorized, listed_at) AS authorized, arg_max_null(source_url, listed_at) AS source_url FROM (SELECT * REPLACE (coalesce(listed_at, TIMESTAMP '1900-01-01') AS listed_at) FROM sources) GROUP BY source_id),
tracked AS (SELECT DISTINCT source_id, path FROM tracked_files WHERE is_regular),
admission AS (SELECT o.source_id, license_spdx, revision, license_file, CASE WHEN coalesce(trim(source_url), '') = '' THEN 'no source url' WHEN NOT coalesce(authorized, false) THEN 'not authorized'
  WHEN NOT coalesce(license_spdx IN ({_quoted(POLICY.allowed_licenses)}), false) THEN 'license not allowed'
  WHEN license_file IS NULL OR starts_with(license_file, '/') OR list_contains(string_split(license_file, '/'), '..') THEN 'unsafe license file'
  WHEN NOT coalesce(regexp_matches(revision, '^[0-9a-f]{{40}}$'), false) THEN 'revision not pinned' WHEN t.path IS NULL THEN 'license file not tracked' END AS reason
  FROM one o LEFT JOIN tracked t ON o.source_id = t.source_id AND o.license_file = t.path)
"""


def _split(ids: str) -> str:
    return f"""(SELECT source_id, CASE WHEN row_number() OVER (ORDER BY sha256('{POLICY.split_salt}' || chr(0) || source_id), source_id) <= least(greatest(1, round_even(count(*) OVER () * {RATIO.validation_fraction}, 0)), count(*) OVER () - 1)
  THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT source_id FROM {ids}))"""


_TOKENS = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\\p{Nd}+|[^\\s\\x0b\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')"
_MASKED = f"[CASE WHEN regexp_full_match(x, '\\p{{Nd}}+') THEN '<NUM>' ELSE x END for x in {_TOKENS}]"
_SHINGLES = f"""w AS (SELECT doc_id, {_MASKED} AS t FROM documents WHERE text IS NOT NULL),
sh AS (SELECT doc_id, unnest([array_to_string(t[i:i + 4], chr(0)) for i in range(1, len(t) + 1)]) AS s FROM w)"""
_BITS = ", ".join(f"(sum((h >> {i}) & 1) * 2 >= count(*))::INT::HUGEINT * {1 << i} AS b{i}" for i in range(64))
_PRINTS = f"""hs AS (SELECT doc_id, ('0x' || sha256(s)[1:16])::UBIGINT AS h FROM sh),
v AS (SELECT doc_id, {_BITS} FROM hs GROUP BY doc_id),
u AS (SELECT doc_id, {" + ".join(f"b{i}" for i in range(64))} AS x FROM v),
p AS (SELECT w.doc_id, coalesce(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END, 0)::BIGINT AS simhash FROM w LEFT JOIN u USING (doc_id))"""
_SIMHASH = f"""
WITH {_SHINGLES},
{_PRINTS}
"""
_RECURSIVE_SHINGLES = "RECURSIVE " + _SHINGLES
# First fingerprints in order, those with near ones only; each is kept unless a kept one is near, which is then its keeper if it is the first.
_KEPT = """g AS (SELECT simhash, min(doc_id) AS r FROM p GROUP BY simhash),
near AS (SELECT a.simhash AS a, b.simhash AS b, a.r AS ra FROM g a JOIN g b ON a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3),
nodes AS (SELECT simhash, r, row_number() OVER (ORDER BY r) AS k FROM g WHERE simhash IN (SELECT a FROM near)),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
  SELECT w.k + 1, CASE WHEN len([x for x in w.kept if bit_count(xor(x, n.simhash)) <= 3]) > 0 THEN w.kept ELSE list_append(w.kept, n.simhash) END FROM walk w JOIN nodes n ON n.k = w.k + 1),
kept AS (SELECT unnest(kept) AS s FROM walk WHERE k = (SELECT max(k) FROM walk)),
gone AS (SELECT b AS simhash, min(ra) AS keeper FROM near WHERE a IN (SELECT s FROM kept) AND b NOT IN (SELECT s FROM kept) GROUP BY b)"""
_EXACT = f"""{_NORMALIZED.replace("WITH f", "WITH RECURSIVE f", 1)}, {_ADMITTED},
sp AS {_split("admission WHERE reason IS NULL")},
k AS (SELECT n.source_id, n.path, n.reason, n.t, sp.split, CASE WHEN n.reason IS NULL THEN sha256(t || chr(10)) END AS sha256, CASE WHEN n.reason IS NULL THEN length(t) + 1 END AS chars,
  CASE WHEN n.reason IS NULL THEN row_number() OVER (PARTITION BY n.reason IS NULL, sha256(t) ORDER BY n.source_id, string_split(n.path, '/')) END AS nth FROM n JOIN sp USING (source_id))"""

SQL = {
    "source_admission": f"WITH {_ADMITTED} SELECT source_id, license_spdx, revision, reason FROM admission",
    "source_split": f"SELECT * FROM {_split('sources')}",
    "path_filter": f"""SELECT DISTINCT source_id, path, {_ALLOWED} AS allowed, {_SUFFIX} AS suffix,
  (list_contains(string_split(path, '/'), '.git') OR lower({_NAME}) = '.env' OR starts_with(lower({_NAME}), '.env.') OR {_SUFFIX} IN ('.key', '.pem')) AS sensitive, {_UNSAFE} AS unsafe FROM tracked_files""",
    "normalized_files": f"{_NORMALIZED} SELECT source_id, path, reason, CASE WHEN reason IS NULL THEN length(t) + 1 END AS chars, CASE WHEN reason IS NULL THEN sha256(t || chr(10)) END AS sha256 FROM n",
    "normalized_documents": f"""WITH d AS (SELECT doc_id, {_strip(_unix("text"))} AS t FROM documents) SELECT doc_id, length(t) AS chars, sha256(t || chr(10)) AS sha256,
  coalesce(CASE WHEN length(t) < 32 THEN 'file_too_short' END, {_sensitive("t")}) AS reason FROM d""",
    "rejection_histogram": f"{_NORMALIZED} SELECT reason, count(*) AS files FROM n WHERE reason IS NOT NULL GROUP BY reason",
    "corpus_decisions": f"""{_NORMALIZED}, {_ADMITTED},
sp AS {_split("admission WHERE reason IS NULL")},
k AS (SELECT n.source_id, n.path, n.reason, sp.split, CASE WHEN n.reason IS NULL THEN row_number() OVER (PARTITION BY n.reason IS NULL, sha256(t) ORDER BY n.source_id, string_split(n.path, '/')) END AS nth FROM n JOIN sp USING (source_id)),
r AS (SELECT coalesce(reason, CASE WHEN nth > 1 THEN 'duplicate' END) AS reason, split FROM k)
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS decision, reason, CASE WHEN reason IS NULL THEN split END AS split, count(*) AS files FROM r GROUP BY ALL""",
    "corpus_records_exact": f"""{_EXACT} SELECT source_id, path, split, license_spdx, sha256, chars FROM k JOIN one USING (source_id) WHERE reason IS NULL AND nth = 1""",
    "corpus_manifest_exact": f"""{_EXACT}, r AS (SELECT coalesce(reason, CASE WHEN nth > 1 THEN 'duplicate' END) AS reason, split FROM k), h AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason)
SELECT '{RATIO.digest()}' AS policy_sha256, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL AND split = 'train') AS train, count(*) FILTER (reason IS NULL AND split = 'validation') AS validation,
  (SELECT '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' FROM h) AS rejection_reasons, (SELECT count(*) FROM sp) AS sources FROM r""",
    "published_corpus": f"""{_EXACT} SELECT 'records:' || split AS part, count(*) AS lines FROM k WHERE reason IS NULL AND nth = 1 GROUP BY split UNION ALL SELECT 'audit', count(*) FROM k""",
    "corpus_audit_native": f"""{_EXACT}, ok AS (SELECT source_id, path, string_split(path, '/') AS parts, sha256, t || chr(10) AS text, row_number() OVER (ORDER BY source_id, string_split(path, '/')) AS doc_id FROM k WHERE reason IS NULL),
w AS (SELECT doc_id, {_MASKED} AS t FROM ok), sh AS (SELECT doc_id, unnest([array_to_string(t[i:i + 4], chr(0)) for i in range(1, len(t) + 1)]) AS s FROM w), {_PRINTS}, {_KEPT},
x AS (SELECT ok.*, p.simhash, min(ok.doc_id) OVER (PARTITION BY sha256) AS f, min(ok.doc_id) OVER (PARTITION BY p.simhash) AS h FROM ok JOIN p USING (doc_id)),
y AS (SELECT x.*, gone.keeper, CASE WHEN gone.keeper IS NOT NULL THEN gone.keeper WHEN f = h AND doc_id <> f THEN f WHEN doc_id <> h THEN h END AS dup FROM x LEFT JOIN gone USING (simhash)),
z AS (SELECT y.source_id, y.path, o.source_id || ':' || o.path AS duplicate_of FROM y LEFT JOIN ok o ON y.dup = o.doc_id)
SELECT k.source_id, k.path, CASE WHEN k.reason IS NULL AND z.duplicate_of IS NULL THEN 'accepted' ELSE 'rejected' END AS decision, coalesce(k.reason, CASE WHEN z.duplicate_of IS NOT NULL THEN 'duplicate' END) AS reason, z.duplicate_of,
  CASE WHEN k.reason IS NULL AND z.duplicate_of IS NULL THEN k.sha256 END AS sha256, CASE WHEN k.reason IS NULL AND z.duplicate_of IS NULL THEN k.split END AS split FROM k LEFT JOIN z USING (source_id, path)""",
    "near_duplicate_greedy_native": f"""WITH {_RECURSIVE_SHINGLES}, {_PRINTS}, {_KEPT}, x AS (SELECT doc_id, simhash, min(doc_id) OVER (PARTITION BY simhash) AS h FROM p)
SELECT doc_id, coalesce(gone.keeper, CASE WHEN doc_id <> h THEN h END) AS duplicate_of FROM x LEFT JOIN gone USING (simhash)""",
    "exact_duplicates": f"""WITH d AS (SELECT doc_id, sha256({_strip(_unix("text"))}) AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS copies FROM d) SELECT doc_id, first_id, copies, doc_id = first_id AS kept FROM c WHERE copies > 1""",
    "token_counts": f"WITH w AS (SELECT doc_id, {_MASKED} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t)::BIGINT AS tokens, len([x for x in t if x = '<NUM>'])::BIGINT AS numbers, sha256(array_to_string(t, chr(0))) AS tokens_sha256 FROM w",
    "top_shingles": f"WITH {_SHINGLES} SELECT replace(s, chr(0), ' ') AS shingle, count(DISTINCT doc_id) AS documents FROM sh GROUP BY s ORDER BY documents DESC, s LIMIT 50",
    "simhash_native": f"{_SIMHASH} SELECT doc_id, simhash FROM p",
    "simhash_bands": f"{_SIMHASH}, b AS (SELECT unnest([0, 1, 2, 3]) AS band, simhash FROM p) SELECT band::BIGINT AS band, (((simhash::HUGEINT + 18446744073709551616) >> (16 * band)) & 65535)::BIGINT AS bucket, count(*) AS documents FROM b GROUP BY ALL",
    "near_duplicate_pairs": f"""{_SIMHASH}, g AS (SELECT simhash, count(*) AS n FROM p GROUP BY simhash)
SELECT a.simhash AS lo, b.simhash AS hi, bit_count(xor(a.simhash, b.simhash))::BIGINT AS distance, a.n AS documents_lo, b.n AS documents_hi FROM g a JOIN g b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
    "line_search": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM s) SELECT doc_id, line, text[1:500] AS text FROM e WHERE regexp_matches(text, '(?:ERROR|FAILED) [a-z]+_[a-z]+') ORDER BY doc_id, line LIMIT 200""",
    "children": f"""WITH c AS (SELECT source_id, string_split(path, '/')[1] AS name, max(CASE WHEN contains(path, '/') THEN 1 ELSE 0 END) AS dir FROM tracked_files WHERE NOT {_UNSAFE} GROUP BY ALL),
ok AS (SELECT source_id, name, CASE WHEN dir = 1 THEN 'directory' ELSE 'file' END AS type, row_number() OVER (PARTITION BY source_id ORDER BY name) AS nth, count(*) OVER (PARTITION BY source_id) AS n FROM c
  WHERE name <> '.git' AND lower(name) <> '.env' AND NOT starts_with(lower(name), '.env.') AND NOT regexp_matches(lower(name), '.[.](key|pem)$'))
SELECT source_id, name, type, n >= 500 AS truncated FROM ok WHERE nth <= 500""",
    "line_slices": rf"""WITH t AS (SELECT doc_id, {_unix("text")} AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, regexp_split_to_array(text, '[\n\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM t), l AS (SELECT doc_id, text, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS l FROM s)
SELECT doc_id, len(l)::BIGINT AS line_count, least(len(l), 4)::BIGINT AS end_line, sha256(array_to_string(l[2:4], chr(10))) AS slice_sha256, sha256(text) AS sha256 FROM l""",
    "redacted_documents": "SELECT doc_id, sha256(regexp_replace("
    + "".join("regexp_replace(" for _ in tx.RECORDED_SECRETS)
    + "text[1:50000]"
    + "".join(f", '{p}', '<REDACTED>', 'g')" for p in tx.RECORDED_SECRETS)
    + r", '(https?://)[^/@\s]+@', '\1<REDACTED>@', 'g')) AS redacted_sha256 FROM documents WHERE text IS NOT NULL",
    "source_digests": f"""WITH f AS ({_FILES}), e AS (SELECT source_id, path, sha256(path)[1:3] AS b, path || chr(0) || CASE WHEN octet_length(content) > {POLICY.max_file_bytes} THEN 'oversize:' || octet_length(content) ELSE sha256(content) END AS p FROM f WHERE is_regular AND content IS NOT NULL),
d AS (SELECT source_id, b, sha256(string_agg(p, chr(10) ORDER BY path)) AS d FROM e GROUP BY source_id, b) SELECT source_id, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM d GROUP BY source_id""",
    "split_overlaps": """WITH r AS (SELECT lower(string_split(source_id, '/')[1]) AS owner, nullif(lower(trim(split)), '') AS split FROM resolved_sources)
SELECT owner, min(split) AS first_split, max(split) AS last_split FROM r GROUP BY owner HAVING min(split) <> max(split)""",
    "license_digests": """WITH r AS (SELECT DISTINCT source_id, license_sha256 FROM resolved_sources WHERE license_sha256 IS NOT NULL), s AS (SELECT DISTINCT source_id, license_file FROM sources),
f AS (SELECT DISTINCT source_id, path AS license_file, sha256(content) AS now FROM tracked_files WHERE is_regular)
SELECT r.source_id, s.license_file, coalesce(now = license_sha256, false) AS unchanged FROM r JOIN s USING (source_id) LEFT JOIN f ON f.source_id = s.source_id AND f.license_file = s.license_file""",
}
