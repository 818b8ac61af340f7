"""Licensed corpus build: admission of sources, rejection of files, duplicates, splits, audit and manifest.

Everything is one lazy plan over two tables; file contents are read once, pass through built-in expressions, and only
fingerprints are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fingerprints, paths
from sparkloom.functions import text as tx
from sparkloom.operators.lineage import cut, sized
from sparkloom.operators.policy import CorpusPolicy


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row for each key: the one with the largest ``by`` (map-side combined, no window). For narrow rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(F.col(by), *[F.col(c).cast("string") for c in rest if c != by]))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_wide(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """As ``latest``, for rows with contents: only those of repeated keys are moved, all others stay in their tasks. Of rows
    with the same ``by``, or none, the one with the largest hash of its other columns is taken."""
    known = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    repeated = known.select(*keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    few = sized(cut(repeated))
    rest = [c for c in df.columns if c not in keys]
    several = known.join(few, keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), F.xxhash64(*rest))).alias("_r"))
    one = several.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return known.join(few, keys, "left_anti").select(*keys, *rest).union(one)


def admit_sources(sources: DataFrame, files: DataFrame, policy: CorpusPolicy, checkouts: DataFrame | None = None) -> DataFrame:
    """Sources with ``reason``: the first rule that a source breaks, null if it is admitted.

    The license file must be one of the source's regular files: files are narrowed to the named ones before anything moves.
    ``checkouts`` (source_id, revision, clean; see ``sources.git_tree``), if given, says what is checked out: a source must be
    there, at the revision that it pins and, if the policy asks for it, without changes.
    """
    one = latest(sources.where("source_id IS NOT NULL"), ["source_id"], "listed_at")
    named = sized(one.where("license_file IS NOT NULL").select("source_id", F.col("license_file").alias("path")))
    held = files.where("is_regular").select("source_id", "path").join(named, ["source_id", "path"], "left_semi").select("source_id", F.col("path").alias("license_file")).distinct().withColumn("license_tracked", F.lit(True))
    joined = one.join(held, ["source_id", "license_file"], "left")
    out_of_place = []
    if checkouts is not None:
        now = checkouts.select("source_id", F.col("revision").alias("_head"), F.coalesce("clean", F.lit(False)).alias("_clean")).groupBy("source_id").agg(F.max_by(F.struct("_head", "_clean"), F.struct("_clean", "_head")).alias("_now"))
        joined = joined.join(now, "source_id", "left").select(*joined.columns, "_now._head", "_now._clean")
        out_of_place = [
            F.when(F.col("_head").isNull(), "no checkout"),
            F.when(F.col("revision").isNotNull() & (F.col("revision") != F.col("_head")), "revision is not checked out"),
            F.when(F.lit(policy.require_clean_git) & ~F.col("_clean"), "uncommitted changes"),
        ]
    reason = F.coalesce(
        F.when(tx.strip("source_id") == "", "no source id"),
        F.when(F.coalesce(tx.strip("source_url"), F.lit("")) == "", "no source url"),
        F.when(~F.coalesce("authorized", F.lit(False)), "not authorized"),
        F.when(~F.coalesce(F.col("license_spdx").isin(*policy.allowed_licenses), F.lit(False)), "license not allowed"),
        F.when(F.col("license_file").isNull() | paths.is_unsafe("license_file"), "unsafe license file"),
        F.when(F.lit(policy.require_pinned_revision) & ~F.coalesce(F.col("revision").rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)), "revision not pinned"),
        *out_of_place,
        F.when(F.col("license_tracked").isNull(), "license file not tracked"),
    )
    return joined.withColumn("reason", reason).drop("license_tracked", "_head", "_clean")


def split_score(source_id: Column | str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("\x00"), source_id), 256)


def split_sources(sources: DataFrame, policy: CorpusPolicy) -> DataFrame:
    """(source_id, split): the sources of lowest score are validation, half-even rounded share of all, at least one on
    either side. Only the number of sources reaches the driver; the k lowest come from a top-k, not a global window."""
    ids = sources.select("source_id").distinct()
    n = ids.count()
    if n < 2:
        raise ValueError("a split needs at least two sources")
    k = min(max(1, round(n * policy.validation_fraction)), n - 1)
    low = ids.select("source_id", split_score("source_id", policy.split_salt).alias("s")).orderBy("s", "source_id").limit(k).select("source_id", F.lit("validation").alias("split"))
    return ids.join(low, "source_id", "left").select("source_id", F.coalesce("split", F.lit("train")).alias("split"))


def normalize_files(files: DataFrame, policy: CorpusPolicy) -> DataFrame:
    """(source_id, path, reason, text): text is null where a reason is given, and ends in one line end elsewhere.

    Reasons in order: path_filtered, not_regular_file, file_too_large, binary_file, invalid_utf8, file_too_short,
    sensitive:<name>. Cheap predicates on the path come first, so contents of filtered files are never decoded.
    """
    raw = F.col("content")
    readable = files.select(
        "source_id",
        "path",
        F.coalesce(
            F.when(~paths.allowed("path", policy.allowed_extensions, policy.allowed_filenames, policy.excluded_globs), "path_filtered"),
            F.when(~F.coalesce("is_regular", F.lit(False)) | raw.isNull(), "not_regular_file"),
            F.when(F.octet_length(raw) > policy.max_file_bytes, "file_too_large"),
            F.when(F.instr(raw.cast("string"), "\x00") > 0, "binary_file"),
            F.when(~F.is_valid_utf8(raw.cast("string")), "invalid_utf8"),
        ).alias("_why"),
        raw.alias("_raw"),
    )
    text = F.when(F.col("_why").isNull(), tx.strip(tx.unix_lines(F.col("_raw").cast("string"))))
    sensitive = (lambda t: F.concat(F.lit("sensitive:"), tx.sensitive_reason(t))) if policy.reject_sensitive_content else (lambda t: F.lit(None).cast("string"))
    verdict = tx.let(text, lambda t: F.struct(F.coalesce(F.col("_why"), F.when(F.length(t) < policy.min_file_chars, "file_too_short"), sensitive(t)).alias("reason"), t.alias("text")))
    out = readable.select("source_id", "path", verdict.alias("_v"))
    return out.select("source_id", "path", "_v.reason", F.when(F.col("_v.reason").isNull(), F.concat("_v.text", F.lit("\n"))).alias("text"))


def order_key() -> Column:
    """Order of files: by source, then by path components."""
    return F.struct(F.col("source_id"), paths.parts("path").alias("parts"))


SALTS = 16


def with_firsts(rows: DataFrame, key: str, first: Column, name: str, spread_by: str = "path") -> DataFrame:
    """``rows`` with ``name``, the aggregate ``first`` over the rows of the same ``key`` (null for keys of a single row).

    Only rows of repeated keys are joined with their aggregate; both sides are salted, as one content (an empty file, a
    license text) may be that of a third of all rows.
    """
    several = rows.groupBy(key).agg(F.count("*").alias("_n"), first.alias(name)).where("_n > 1").drop("_n")
    several = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(several, [key, "_salt"], "left").drop("_salt")


def near_keys(h: Column | str, blocks: int = 5, kept: int = 2) -> Column:
    """Keys of which two fingerprints at distance ``blocks - kept`` or less share one: all choices of ``kept`` blocks.

    Longer keys than single bands make far smaller buckets for the same guarantee.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), kept)):
        value = F.lit(n).cast("bigint")
        for b in choice:
            width = edges[b + 1] - edges[b]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(h, edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        keys.append(value)
    return F.array(*keys)


def near_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(lo, hi, distance) of all pairs of distinct fingerprints (column simhash) within ``distance``, lo < hi.

    Equal fingerprints must be collapsed before; then no bucket holds copies.
    """
    keyed = prints.select("simhash", F.explode(near_keys("simhash", 2 + distance)).alias("k"))
    a, b = keyed.select(F.col("simhash").alias("lo"), "k"), keyed.select(F.col("simhash").alias("hi"), "k")
    d = fingerprints.hamming("lo", "hi")
    return a.join(b, "k").where(F.col("lo") < F.col("hi")).where(d <= distance).select("lo", "hi", d.cast("int").alias("distance")).distinct()


def greedy_keep(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(simhash, keeper) of the fingerprints that are dropped, keeper being the first kept neighbour.

    ``nodes`` has simhash and rank (any ordered type, distinct). A node is kept unless an already kept one of lower rank
    is its neighbour - the lexicographically first maximal independent set, found in rounds: nodes without undecided
    lower neighbours are kept, their neighbours dropped. Edges are cut to the checkpoint folder after every round.
    """
    r = nodes.select("simhash", "rank")
    one = pairs.join(r.withColumnsRenamed({"simhash": "lo", "rank": "ra"}), "lo").join(r.withColumnsRenamed({"simhash": "hi", "rank": "rb"}), "hi")
    swap = F.col("ra") > F.col("rb")
    edges = cut(one.select(F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("first"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("second"), F.least("ra", "rb").alias("rank")))
    every, dropped = edges, None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        kept = edges.select(F.col("first").alias("k")).distinct().join(edges.select(F.col("second").alias("k")).distinct(), "k", "left_anti")
        gone = cut(edges.join(kept, edges["first"] == kept["k"]).select(F.col("second").alias("g")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        edges = cut(edges.join(gone, edges["second"] == gone["g"], "left_anti").join(gone, edges["first"] == gone["g"], "left_anti"))
    else:
        raise RuntimeError("greedy rounds did not end")
    if dropped is None:
        return nodes.sparkSession.createDataFrame([], "simhash BIGINT, keeper BIGINT")
    lost = dropped.distinct()
    of_kept = every.join(lost, every["first"] == lost["g"], "left_anti")
    found = of_kept.join(lost, of_kept["second"] == lost["g"], "left_semi")
    return found.groupBy(F.col("second").alias("simhash")).agg(F.min_by("first", "rank").alias("keeper"))


def fingerprint_files(texts: DataFrame, near: bool = True, native: bool = False) -> DataFrame:
    """(source_id, path, reason, sha256, simhash) of normalized files: all that later steps need of their texts. ``native``
    takes the shingle hashes from SHA-256 instead of BLAKE2, which built-in functions (and SQL) can compute."""
    if near and native:
        return fingerprints.with_simhash(texts, "text").select("source_id", "path", "reason", tx.content_sha256("text").alias("sha256"), "simhash")
    return texts.select("source_id", "path", "reason", tx.content_sha256("text").alias("sha256"), (fingerprints.simhash("text") if near else F.lit(None).cast("bigint")).alias("simhash"))


def decide(rows: DataFrame, policy: CorpusPolicy, near: bool = True) -> DataFrame:
    """(source_id, path, sha256, duplicate_of) of fingerprinted files without a reason; duplicate_of is null for those kept."""
    first = F.min(F.struct("source_id", paths.parts("path").alias("parts"), "path"))
    identity = lambda c: F.concat(F.col(f"{c}.source_id"), F.lit(":"), F.col(f"{c}.path"))
    out = with_firsts(rows, "sha256", first, "f")
    copy = F.col("f").isNotNull() & ((F.col("source_id") != F.col("f.source_id")) | (F.col("path") != F.col("f.path")))
    if not near:
        return out.select("source_id", "path", "sha256", F.when(copy, identity("f")).alias("duplicate_of"))
    heads = rows.groupBy("simhash").agg(first.alias("h"))
    nodes = heads.select("simhash", F.struct("h.source_id", "h.parts").alias("rank"))
    gone = greedy_keep(nodes, near_pairs(nodes.select("simhash"), policy.near_duplicate_hamming_distance))
    keeper = gone.join(heads.withColumnsRenamed({"simhash": "keeper", "h": "k"}), "keeper").select("simhash", "k")
    full = with_firsts(out, "simhash", first, "h").join(sized(keeper), "simhash", "left")
    not_head = F.col("h").isNotNull() & ((F.col("source_id") != F.col("h.source_id")) | (F.col("path") != F.col("h.path")))
    same_content_kept = F.col("k").isNull() & (F.col("f.source_id") == F.col("h.source_id")) & (F.col("f.path") == F.col("h.path"))
    of = F.coalesce(F.when(F.col("k").isNotNull(), identity("k")), F.when(same_content_kept & copy, identity("f")), F.when(not_head, identity("h")))
    return full.select("source_id", "path", "sha256", of.alias("duplicate_of"))


#: Up to so many accepted files their metadata is sent to the executors; beyond, it is joined by shuffle.
BROADCAST_WIDE = 50_000


class Frames(Mapping):
    """Frames by name, each planned when it is first asked for."""

    def __init__(self, plans: dict[str, Callable[[], DataFrame]]):
        self._plans = {n: cache(f) for n, f in plans.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._plans[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def build(sources: DataFrame, files: DataFrame, policy: CorpusPolicy | None = None, near: bool = True, native: bool = False, checkouts: DataFrame | None = None) -> Frames:
    """Frames ``records``, ``audit`` and ``manifest`` of a build over the admitted sources.

    Sources that are not admitted are left out (see ``admit_sources`` for why); every file of the others has one audit row.
    Contents are read and normalized once for their fingerprints, which is all that is shuffled or kept, and once more when
    the records are asked for.
    """
    policy = policy or CorpusPolicy()
    admitted = cut(admit_sources(sources, files, policy, checkouts).where("reason IS NULL").drop("reason"))
    splits = split_sources(admitted, policy)
    mine = latest_wide(files.join(sized(splits.select("source_id")), "source_id", "left_semi"), ["source_id", "path"], "scanned_at")
    texts = normalize_files(mine, policy)
    prints = cut(fingerprint_files(texts, near, native))
    decided = decide(prints.where("reason IS NULL").drop("reason"), policy, near)
    accepted = F.coalesce("reason", "duplicate_of").isNull()
    audit = cut(
        prints.select("source_id", "path", "reason")
        .join(decided, ["source_id", "path"], "left")
        .join(splits, "source_id")
        .select(
            "source_id",
            "path",
            F.when(accepted, "accepted").otherwise("rejected").alias("decision"),
            F.coalesce("reason", F.when(F.col("duplicate_of").isNotNull(), "duplicate")).alias("reason"),
            "duplicate_of",
            F.when(accepted, F.col("sha256")).alias("sha256"),
            F.when(accepted, F.col("split")).alias("split"),
        )
    )

    def locked() -> DataFrame:
        licenses = files.where("is_regular").join(sized(admitted.select("source_id", F.col("license_file").alias("path"))), ["source_id", "path"]).select("source_id", F.col("path").alias("license_file"), F.sha2("content", 256).alias("license_sha256")).distinct()
        return cut(admitted.join(splits, "source_id").join(licenses, ["source_id", "license_file"]))

    locked = cache(locked)

    def records() -> DataFrame:
        metadata = F.struct("license_file", "license_sha256", "license_spdx", "path", "revision", "sha256", "source_id", "source_url", "split")
        kept = audit.where("decision = 'accepted'").select("source_id", "path", "sha256")
        named = kept.join(locked().select("source_id", "license_file", "license_sha256", "license_spdx", "revision", "source_url", "split"), "source_id")
        # rows of some 600 bytes: fewer of them are sent than of narrow ones
        return texts.where("reason IS NULL").select("source_id", "path", "text").join(sized(named, BROADCAST_WIDE), ["source_id", "path"]).select("text", metadata.alias("metadata"))

    return Frames({"records": records, "audit": lambda: audit, "manifest": lambda: manifest(audit, locked(), policy)})


def rejections(audit: DataFrame) -> DataFrame:
    return audit.where("decision = 'rejected'").groupBy("reason").agg(F.count("*").alias("files"))


def manifest(audit: DataFrame, locked: DataFrame, policy: CorpusPolicy) -> DataFrame:
    """One row: format_version, policy_sha256, counts, rejection_reasons (by key) and the locked sources (by id)."""
    counts = audit.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in (("accepted", F.col("decision") == "accepted"), ("rejected", F.col("decision") == "rejected"), ("train", F.col("split") == "train"), ("validation", F.col("split") == "validation"))))
    reasons = rejections(audit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "files")))).alias("rejection_reasons"))
    names = ["authorized", "license_spdx", "license_file", "license_sha256", "path", "revision", "source_url", "split"]
    lock = locked.agg(F.array_sort(F.collect_list(F.struct("source_id", *names))).alias("sources"))
    one = counts.select(F.struct("accepted", "rejected", "train", "validation").alias("counts"))
    return one.crossJoin(reasons).crossJoin(lock).select(F.lit(1).alias("format_version"), F.lit(policy.digest()).alias("policy_sha256"), "counts", "rejection_reasons", "sources")  # one row each


def folded_digest(df: DataFrame, by: str, order: str, content: str, most: int = 1_000_000) -> DataFrame:
    """(by, digest): one digest over the group's members, each as its key, NUL and the digest of its content (or a mark where
    that is larger than ``most``).

    Folded in two levels: members are digested in 4,096 buckets of the hash of their key, each in order of the keys, and the
    buckets of a group in order of their numbers. So no task gathers a group; a bucket holds 1/4,096 of it.
    """
    part = F.when(F.octet_length(content) > most, F.concat(F.lit("oversize:"), F.octet_length(content).cast("string"))).otherwise(F.sha2(content, 256))
    each = df.select(by, F.substring(F.sha2(F.col(order), 256), 1, 3).alias("b"), F.struct(F.col(order).alias("k"), F.concat(F.col(order), F.lit("\x00"), F.coalesce(part, F.lit(""))).alias("p")).alias("m"))
    fold = lambda items: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda m: m["p"]), "\n"), 256)
    buckets = each.groupBy(by, "b").agg(fold("m").alias("d"))
    return buckets.groupBy(by).agg(fold(F.struct(F.col("b").alias("k"), F.concat("b", F.lit(":"), "d").alias("p"))).alias("digest"))


def split_overlap(assigned: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split; none if the splits are disjoint."""
    return assigned.groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split")).where("first_split <> last_split")
