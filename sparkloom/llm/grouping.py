"""Problem 2: splits that keep related records together.

Sources are linked by owner, author and repository; ``linked_groups`` finds the groups by alternating large-star and
small-star rounds. ``allocate`` then assigns whole groups to splits: components of one size and label make a bundle,
a min-cost flow sends the bundles' records to the splits (cost of leaving the present split, much larger cost of missing
a quota), the flow is rounded to whole components, and a bundle's members are told apart by hash.

Defined results: null or blank ids, owners, authors and addresses link nothing; repeated rows count once; split values are
compared without case and surrounding spaces, blank ones mean not assigned; sources without any record have size zero
and stay where they are (train if nowhere); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.operators.lineage import cut

SPLITS = ("train", "validation", "test")
SALTS = 16


def clean(column: str | F.Column) -> F.Column:
    """Without case and surrounding white space; blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def repository_key(url: F.Column) -> F.Column:
    """Host and path of a repository's address, in lower case: no scheme, user, port, query, ``.git`` or final slash."""
    u = clean(url)
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^[^/@]*@", "")
    u = F.regexp_replace(u, r"^(\[[^\]]*\]|[^/:]+):\d+(?=/|$)", "$1")  # a port
    u = F.regexp_replace(u, r"^([^/:]+):/*", "$1/")  # host:path
    u = F.regexp_replace(u, r"/+", "/")
    u = F.regexp_replace(u, r"(?:/|\.git)+$", "")
    return F.nullif(u, F.lit(""))


def author_key(author: F.Column) -> F.Column:
    """The mail address in lower case; a name without an address identifies nobody."""
    return F.nullif(F.lower(F.regexp_extract(author, r"([^\s<>\"'(),;:]+@[^\s<>\"'(),;:]+)", 1)), F.lit(""))


def owner_key(source_id: F.Column) -> F.Column:
    return F.when(F.instr(source_id, "/") > 1, clean(F.substring_index(source_id, "/", 1)))


def source_links(sources: DataFrame, contributors: DataFrame) -> DataFrame:
    """Distinct (source_id, key): what a source shares with those it is linked to."""
    s = sources.select("source_id", "source_url").where("source_id IS NOT NULL")
    c = contributors.select("source_id", "author").where("source_id IS NOT NULL")
    ids = s.select("source_id").union(c.select("source_id")).distinct()
    links = (
        ids.select("source_id", F.concat(F.lit("o:"), owner_key(F.col("source_id"))).alias("key"))
        .union(s.select("source_id", F.concat(F.lit("r:"), repository_key(F.col("source_url")))))
        .union(c.select("source_id", F.concat(F.lit("a:"), author_key(F.col("author")))))
    )
    return links.where("key IS NOT NULL").distinct()


def _with_least(pairs: DataFrame, by: str, value: str, least: str) -> DataFrame:
    """``pairs`` with the smallest ``value`` of each ``by``. Both sides are salted: one ``by`` may hold a third of the rows."""
    low = pairs.groupBy(by).agg(F.min(value).alias(least))
    low = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(low, [by, "_salt"]).drop("_salt")


def connected_groups(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(source_id, group_head) of every source in ``links`` (source_id, key); group_head is the group's smallest id.

    Members of a key are first linked to its smallest one; then large-star and small-star rounds until no edge changes.
    Every round is written to the checkpoint folder. Only counts and sums of hashes reach the driver.
    """
    nodes = links.select("source_id").distinct()
    edges = cut(_with_least(links, "key", "source_id", "head").where("source_id <> head").select(F.col("source_id").alias("u"), F.col("head").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both, "u", "v", "m").select("v", F.least("u", "m").alias("m"), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now runs from the larger to the smaller end
        small = _with_least(large, "u", "v", "m")
        edges = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return nodes.join(edges.select(F.col("u").alias("source_id"), F.col("v").alias("group_head")), "source_id", "left").select("source_id", F.coalesce("group_head", "source_id").alias("group_head"))
        before = state
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def assigned_splits(resolved: DataFrame) -> DataFrame:
    """Distinct (source_id, split) of the assigned sources."""
    return resolved.select("source_id", clean("split").alias("split")).where("source_id IS NOT NULL AND split IS NOT NULL").distinct()


def linked_groups(sources: DataFrame, contributors: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source_id, group_head) of every source of the three tables."""
    ids = sources.select("source_id").union(contributors.select("source_id")).union(resolved.select("source_id")).where("source_id IS NOT NULL").distinct()
    # a key of its own keeps sources without owner, author and address
    own = ids.select("source_id", F.concat(F.lit("s:"), "source_id").alias("key"))
    owners = ids.select("source_id", F.concat(F.lit("o:"), owner_key(F.col("source_id"))).alias("key")).where("key IS NOT NULL")
    return connected_groups(source_links(sources, contributors).union(owners).union(own).distinct())


def separated_groups(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """Members (group_head, source_id) of groups whose assigned members are in more than one split."""
    split = assigned_splits(resolved).join(groups, "source_id")
    torn = split.groupBy("group_head").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("group_head")
    return groups.join(torn, "group_head", "left_semi").select("group_head", "source_id").distinct()


@dataclass(frozen=True)
class Bundle:
    size: int
    label: int  # index of the present split, -1 if none
    count: int


def min_cost_flow(bundles: list[Bundle], quotas: np.ndarray, move_cost: float = 1.0) -> np.ndarray:
    """Records of each bundle to send to each split: quotas met exactly, at the least cost of moving.

    Leaving the present split costs ``move_cost`` a record, and a missed quota costs more than any moves, so the optimum
    meets all quotas. Starting from the cheapest assignment, the cheapest residual paths from splits above their
    quota to splits below it are filled one after the other. With so few splits a path's arcs are the best bundle for
    each ordered pair of splits, found by looking through the bundles at hand.
    """
    k = len(quotas)
    mass = np.array([b.size * b.count for b in bundles], float)
    label = np.array([b.label for b in bundles])
    cost = np.full((len(bundles), k), move_cost)
    cost[label < 0] = 0.0
    for s in range(k):
        cost[label == s, s] = 0.0
    flow = np.zeros((len(bundles), k))
    for i, b in enumerate(bundles):
        if b.label >= 0:
            flow[i, b.label] = mass[i]
        else:
            flow[i] = mass[i] * quotas / max(quotas.sum(), 1e-9)
    eps = 1e-9 * max(1.0, mass.sum())
    for _ in range(8 * k * k * (len(bundles) + 1)):
        over = flow.sum(0) - quotas
        if over.max() <= eps:
            break
        arc, via = np.full((k, k), np.inf), np.zeros((k, k), int)
        for s in range(k):
            has = np.flatnonzero(flow[:, s] > eps)
            if len(has):
                for t in range(k):
                    if t != s:
                        step = cost[has, t] - cost[has, s]
                        j = int(step.argmin())
                        arc[s, t], via[s, t] = step[j], has[j]
        best = None
        for s in np.flatnonzero(over > eps):
            dist, back = np.full(k, np.inf), np.full(k, -1)
            dist[s] = 0.0
            for _ in range(k - 1):
                for a in range(k):
                    for b in range(k):
                        if dist[a] + arc[a, b] < dist[b] - 1e-12:
                            dist[b], back[b] = dist[a] + arc[a, b], a
            for t in np.flatnonzero(over < -eps):
                if np.isfinite(dist[t]) and (best is None or dist[t] < best[0]):
                    path, at = [], t
                    while at != s:
                        path.append((int(back[at]), int(at)))
                        at = back[at]
                    best = (dist[t], s, t, path)
        if best is None:
            break
        _, s, t, path = best
        amount = min(over[s], -over[t], *(flow[via[a, b], a] for a, b in path))
        for a, b in path:
            flow[via[a, b], a] -= amount
            flow[via[a, b], b] += amount
    return flow


def bundle_flow(bundles: list[Bundle], quotas: np.ndarray, move_cost: float = 1.0) -> np.ndarray:
    """``min_cost_flow`` for any number of bundles: costs depend on the label only, so the bundles of a label flow as one.

    The label's flow is then handed to its bundles from the largest components down, the present split first. So it is small
    components that move, and at most one bundle of a label is divided at each split.
    """
    labels = sorted({b.label for b in bundles})
    mass = {x: sum(b.size * b.count for b in bundles if b.label == x) for x in labels}
    merged = min_cost_flow([Bundle(1, x, mass[x]) for x in labels], quotas, move_cost)
    flow = np.zeros((len(bundles), len(quotas)))
    for x, left in zip(labels, merged):
        order = sorted(range(len(quotas)), key=lambda t: (t != x, -left[t]))
        left = left.copy()
        for i in sorted((i for i, b in enumerate(bundles) if b.label == x), key=lambda i: -bundles[i].size):
            need = float(bundles[i].size * bundles[i].count)
            for t in order:
                part = min(need, left[t])
                flow[i, t] += part
                left[t] -= part
                need -= part
            flow[i, order[-1]] += need  # what rounding left over
    return flow


def round_whole(bundles: list[Bundle], flow: np.ndarray, quotas: np.ndarray) -> np.ndarray:
    """Whole components of each bundle for each split: floors first, then what is left over, largest components first.

    Such a component stays in its present split, or goes where the flow sends it, if that brings the split nearer to its
    quota; else it goes to the split that is furthest below its quota.
    """
    counts = np.zeros(flow.shape, int)
    for i, b in enumerate(bundles):
        if b.size:
            counts[i] = np.floor(flow[i] / b.size + 1e-9).astype(int)
        else:
            counts[i, b.label if b.label >= 0 else 0] = b.count
    filled = (counts * np.array([b.size for b in bundles]).reshape(-1, 1)).sum(0).astype(float)
    for i in sorted(range(len(bundles)), key=lambda i: -bundles[i].size):
        b = bundles[i]
        for _ in range(b.count - int(counts[i].sum())):
            gap = lambda t: quotas[t] - filled[t]  # noqa: B023, E731
            s = max(range(len(quotas)), key=lambda t: (gap(t) >= b.size / 2, t == b.label if gap(t) >= b.size / 2 else False, flow[i, t] if gap(t) >= b.size / 2 else 0.0, gap(t)))  # noqa: B023
            counts[i, s] += 1
            filled[s] += b.size
    return counts


def allocate(components: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 17, buckets: int = 256) -> DataFrame:
    """Split of each component (group_head, size, label); label is the present split or null.

    The driver gets one row for each size and label: distinct sizes of components add up to at most the number of
    records, so there are at most 4 * sqrt(2 * records) of them. Members of a bundle are ordered by hash, in buckets
    of the hash, and the first ones go to the first split and so on; no bundle is sorted in one task.
    """
    comps = components.select("group_head", F.col("size").cast("bigint").alias("size"), F.coalesce(F.array_position(F.array(*map(F.lit, SPLITS)), F.col("label")).cast("int") - 1, F.lit(-1)).alias("label"))
    rows = comps.groupBy("size", "label").agg(F.count("*").alias("n")).collect()
    bundles = sorted((Bundle(r["size"], r["label"], r["n"]) for r in rows), key=lambda b: (b.size, b.label))
    quotas = np.array(shares) / sum(shares) * sum(b.size * b.count for b in bundles)
    counts = round_whole(bundles, bundle_flow(bundles, quotas), quotas)
    ends = np.cumsum(counts, axis=1)
    plan = components.sparkSession.createDataFrame([(b.size, b.label, *map(int, e)) for b, e in zip(bundles, ends)], T.StructType([T.StructField("size", T.LongType()), T.StructField("label", T.IntegerType()), *(T.StructField(f"end_{s}", T.LongType()) for s in SPLITS)]))
    h = F.xxhash64("group_head", F.lit(seed))
    placed = comps.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    in_bucket = placed.groupBy("size", "label", "bucket").agg(F.count("*").alias("n"))
    before = in_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("size", "label").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("size", "label", "bucket").orderBy("h", "group_head"))).join(before, ["size", "label", "bucket"])
    rank = F.col("before") + F.col("rank")
    small = F.broadcast(plan) if len(bundles) <= 100_000 else plan
    split = F.when(rank <= F.col("end_train"), "train").when(rank <= F.col("end_validation"), "validation").otherwise("test")
    return ranked.join(small, ["size", "label"]).select("group_head", "size", split.alias("split"))


def group_sizes(groups: DataFrame, resolved: DataFrame, records: DataFrame, record_id: str = "traj_id") -> DataFrame:
    """(group_head, size, label): records of a group, and the split that most of its records have now."""
    n = records.where(f"source_id IS NOT NULL AND {record_id} IS NOT NULL").select("source_id", record_id).distinct().groupBy("source_id").agg(F.count("*").alias("n"))
    now = assigned_splits(resolved).groupBy("source_id").agg(F.min("split").alias("split"))
    each = groups.join(n, "source_id", "left").join(now, "source_id", "left").select("group_head", "split", F.coalesce("n", F.lit(0)).alias("n"))
    by = each.groupBy("group_head", "split").agg(F.sum("n").alias("n"))
    label = F.max_by(F.col("split"), F.when(F.col("split").isin(*SPLITS), F.struct(F.col("n"), F.col("split"))))
    return by.groupBy("group_head").agg(F.sum("n").alias("size"), label.alias("label"))


def safe_splits(sources: DataFrame, contributors: DataFrame, resolved: DataFrame, records: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 17) -> DataFrame:
    """(source_id, group_head, split) of every source; all members of a group have one split."""
    groups = cut(linked_groups(sources, contributors, resolved))
    comps = cut(group_sizes(groups, resolved, records))
    return groups.join(allocate(comps, shares, seed), "group_head").select("source_id", "group_head", "split")
