import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import grouping as G

SOURCES, PEOPLE = "source_id STRING, source_url STRING", "source_id STRING, author STRING"
RESOLVED, RECORDS = "source_id STRING, split STRING", "traj_id BIGINT, source_id STRING"


def test_keys(spark):
    same = ["https://git.x.example/o/r", "http://GIT.X.example/O/r.git/", "git@git.x.example:o/r.git", "ssh://git@git.x.example:22/o/r", "git://git.x.example/o/r//", " https://u:p@git.x.example:443/o/r.git?ref=1 "]
    other = ["https://git.y.example/o/r", "https://git.x.example/o/r2", "https://git.x.example/o/r.github"]
    key = lambda u: spark.createDataFrame([(u,)], "u STRING").select(G.repository_key(G.F.col("u")).alias("k")).first().k
    assert {key(u) for u in same} == {"git.x.example/o/r"} and len({key(u) for u in other}) == 3 and key(None) is None and key(" ") is None
    mail = lambda a: spark.createDataFrame([(a,)], "a STRING").select(G.author_key(G.F.col("a")).alias("k")).first().k
    assert {mail(a) for a in ("A B <x.y@Mail.example>", '"B" <X.Y@mail.example>', "  x.y@mail.example ")} == {"x.y@mail.example"} and mail("Just Name") is None and mail(None) is None and mail(" ") is None


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        if not x.startswith("key:"):
            groups.setdefault(find(x), []).append(x)
    return {m: min(g) for g in groups.values() for m in g}


def test_groups_equal_union_find(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(300):03}", f"k{rng.randrange(260)}") for _ in range(330)] + [(f"p{i:03}", f"path{i // 2}") for i in range(60)] + [(f"p{i:03}", f"path{(i + 1) // 2}x") for i in range(60)] + [(f"h{i:04}", "hot") for i in range(2000)]
    df = spark.createDataFrame(links, "source_id STRING, key STRING")
    got = {r.source_id: r.group_head for r in G.connected_groups(df).collect()}
    assert got == union_find([(a, "key:" + b) for a, b in links]) and got["h1999"] == "h0000" and got["p059"] == "p000"


def tables(spark, sources, people, resolved, records=()):
    return (spark.createDataFrame(sources, SOURCES), spark.createDataFrame(people, PEOPLE), spark.createDataFrame(resolved, RESOLVED), spark.createDataFrame(list(records), RECORDS))


def test_separated_groups(spark):
    s, c, r, _ = tables(
        spark,
        [("o/a", "https://h/1"), ("O/b", None), ("p/c", "git@h:1.git"), ("q/d", None), ("r/e", None), ("x", None), (None, "https://h/1"), ("o/a", "https://h/1")],
        [("q/d", "N <m@m.example>"), ("r/e", "M@M.example"), ("r/e", None), ("x", " "), (None, "m@m.example")],
        [("o/a", " Train"), ("p/c", "TEST"), ("q/d", "train"), ("r/e", None), ("r/e", ""), ("x", "test"), ("x", "test ")],
    )
    groups = G.linked_groups(s, c, r)
    assert {(g.group_head, g.source_id) for g in G.separated_groups(groups, r).collect()} == {("O/b", "O/b"), ("O/b", "o/a"), ("O/b", "p/c")}
    more = G.linked_groups(s.selectExpr("*", "1 AS key", "2 AS u"), c.selectExpr("*", "3 AS head"), r.selectExpr("*", "4 AS label"))
    assert {tuple(x) for x in more.collect()} == {tuple(x) for x in groups.collect()}
    assert G.linked_groups(s.limit(0), c.limit(0), r.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(-1, 2), st.integers(1, 20)), min_size=1, max_size=12))
def test_flow_meets_quotas_at_least_cost(rows):
    bundles = [G.Bundle(*r) for r in rows]
    total = sum(b.size * b.count for b in bundles)
    quotas = np.array([0.8, 0.1, 0.1]) * total
    for flow in (G.min_cost_flow(bundles, quotas), G.bundle_flow(bundles, quotas)):
        check_flow(bundles, quotas, flow)


def check_flow(bundles, quotas, flow):
    total = sum(b.size * b.count for b in bundles)
    assert np.allclose(flow.sum(0), quotas, atol=1e-6 * total + 1e-6) and np.allclose(flow.sum(1), [b.size * b.count for b in bundles]) and (flow > -1e-6).all()
    moved = sum(flow[i].sum() - flow[i, b.label] for i, b in enumerate(bundles) if b.label >= 0)
    have = np.array([sum(b.size * b.count for b in bundles if b.label == s) for s in range(3)])
    assert moved <= np.maximum(have - quotas, 0).sum() + 1e-6 * total + 1e-6  # only what is over a quota has to move
    counts = G.round_whole(bundles, flow, quotas)
    assert (counts.sum(1) == [b.count for b in bundles]).all() and (counts >= 0).all()
    filled = (counts * np.array([[b.size] for b in bundles])).sum(0)
    assert (np.abs(filled - quotas) <= 2 * sum(b.size for b in bundles) + 1e-6).all()


def test_many_bundles_are_allocated_quickly():
    import time

    bundles = [G.Bundle(s, label, 3) for s in range(1, 8000) for label in (-1, 0, 1, 2)]
    quotas = np.array([0.8, 0.1, 0.1]) * sum(b.size * b.count for b in bundles)
    begin = time.perf_counter()
    counts = G.round_whole(bundles, G.bundle_flow(bundles, quotas), quotas)
    filled = (counts * np.array([[b.size] for b in bundles])).sum(0)
    assert np.abs(filled - quotas).max() <= 8000 and time.perf_counter() - begin < 20


def test_splits_keep_groups_together_and_reach_the_shares(spark):
    rng = random.Random(8)
    sources = [(f"o{rng.randrange(250)}/r{i}", f"https://h/{i}") for i in range(500)]
    resolved = [(s, rng.choice(["train"] * 6 + ["validation", "test", None])) for s, _ in sources[:450]]
    records = [(i, rng.choice(sources)[0]) for i in range(4000)] + [(5000, None), (None, sources[0][0])]
    s, c, r, t = tables(spark, sources, [(sources[0][0], "a@b.example"), (sources[9][0], "A@b.example")], resolved, records)
    out = {x.source_id: (x.group_head, x.split) for x in G.safe_splits(s, c, r, t.union(t)).collect()}
    assert set(out) == {i for i, _ in sources}
    by = {}
    for head, split in out.values():
        assert by.setdefault(head, split) == split
    n = {k: sum(out[sid][1] == k for i, sid in records if i is not None and sid) / 4000 for k in G.SPLITS}
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["validation"] - 0.1) < 0.01
    assert {x.source_id: x.split for x in G.safe_splits(s, c, r, t).collect()} == {k: v[1] for k, v in out.items()}  # the same again
    assert G.safe_splits(s.limit(0), c.limit(0), r.limit(0), t.limit(0)).count() == 0
    assert G.safe_splits(s, c, r, t.limit(0)).count() == 500
