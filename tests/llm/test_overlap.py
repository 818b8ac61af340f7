import random

from conftest import MESSAGE, message
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import overlap as O
from sparkloom.llm.words import split_words

RESOLVED = "source_id STRING, split STRING"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 30))
def test_word_distance(a, b, limit):
    want, got = plain_distance(a, b), O.word_distance(a, b, limit)
    assert got == want if want <= limit else got > limit


def test_chain_rises_in_both():
    seeds = [(0, 5, 3), (4, 0, 3), (5, 8, 3), (6, 2, 3), (9, 9, 3), (9, 3, 3)]
    line = O.chain(seeds)
    assert len(line) == 3 and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(line, line[1:])) and O.covered([(0, 0, 5), (3, 3, 5), (20, 9, 4)]) == 12
    assert O.chain([]) == []


def test_long_records_are_aligned_exactly():
    rng = random.Random(1)
    import numpy as np

    a = np.array([rng.randrange(10_000) for _ in range(25_000)], np.uint32)
    b = a.copy()
    b[::50] = 77
    assert O.word_distance(a.tolist(), b.tolist(), 5000) == 500


def trajectories(spark, rows):
    return spark.createDataFrame([(i, s, None if t is None else [message("system", f"shared system text {i % 3}"), message("user", t), message("assistant", None), message("tool", "")]) for i, s, t in rows], f"traj_id BIGINT, source_id STRING, messages ARRAY<{MESSAGE}>")


def brute(rows, splits):
    side = {s: x.strip().lower() for s, x in splits if x and x.strip()}
    have = [(i, side[s] == "train", split_words(t or "")) for i, s, t in rows if s in side and i is not None]
    out = set()
    for i, t, a in have:
        for j, u, b in have:
            if t and not u and i != j and a and b and 1 - plain_distance(a, b) / max(len(a), len(b)) > 0.8 + 1e-12:
                out.add((i, j))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    splits = [("a", "train"), ("b", " Test"), ("c", "VALIDATION"), ("d", ""), ("e", None), ("a", "train")]
    rows, n = [], 0
    for _ in range(130):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 9, 20, 40, 90, 250]))]
        for _ in range(rng.choice([1, 2, 3])):
            t = list(base)
            for _ in range(rng.choice([0, 0, len(t) // 20, len(t) // 8, len(t) // 6, len(t) // 3])):
                k = rng.randrange(len(t))
                op = rng.randrange(3)
                if op == 0:
                    t[k] = rng.choice(vocab)
                elif op == 1:
                    t.insert(k, rng.choice(vocab))
                elif len(t) > 1:
                    t.pop(k)
            rows.append((n, rng.choice("aaabbbcde"), " ".join(t).replace("w1 ", "W1-")))
            n += 1
    rows += [(n, "a", None), (n + 1, "b", None), (n + 2, None, rows[0][2]), (n + 3, "a", "")]
    df, r = trajectories(spark, rows), spark.createDataFrame(splits, RESOLVED)
    got = {(x.train_id, x.held_id): x for x in O.overlaps(df, r).collect()}
    want = brute(rows, splits)
    assert set(got) == want and len(want) > 15
    assert all(x.similarity > 0.8 and x.held_split in ("test", "validation") for x in got.values())
    again = O.overlaps(df.union(df).selectExpr("*", "1 AS key", "2 AS n", "true AS train", "'z' AS split"), r.selectExpr("*", "3 AS traj_id"))
    assert {(x.train_id, x.held_id) for x in again.collect()} == want
    assert O.overlaps(df.limit(0), r).count() == 0 and O.overlaps(df, r.limit(0)).count() == 0


def test_shared_passage_in_most_records(spark):
    """A form that all records share makes no candidates of them, and hides no true pair."""
    rng = random.Random(9)
    form = " ".join(f"form{i}" for i in range(60))
    own = lambda: " ".join(f"u{rng.randrange(100_000)}" for _ in range(120))
    rows = [(i, "a" if i % 2 else "b", f"{own()} {form} {own()}") for i in range(300)]
    rows += [(1000, "a", f"{form} {(x := own())}"), (1001, "b", f"{form} {x} more")]
    df, r = trajectories(spark, rows), spark.createDataFrame([("a", "train"), ("b", "test")], RESOLVED)
    assert {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()} == {(1000, 1001)}


def test_copies_are_written_out(spark):
    rows = [(i, "a", "the very same words in all of these records here") for i in range(40)] + [(100 + i, "b", "The very same words, in all of these records here!") for i in range(3)]
    df, r = trajectories(spark, rows), spark.createDataFrame([("a", "train"), ("b", "test")], RESOLVED)
    assert {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()} == {(i, 100 + j) for i in range(40) for j in range(3)}


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    rows = [(i, "a", f"words {i} that are all alike but for the number at the end {i}") for i in range(30)] + [(50 + i, "b", f"words {i} that are all alike but for the number at the end {i}") for i in range(30)]
    df, r = trajectories(spark, rows), spark.createDataFrame([("a", "train"), ("b", "test")], RESOLVED)
    want = {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()}
    monkeypatch.setattr(O, "BROADCAST_IDS", -1)
    monkeypatch.setattr(O, "BROADCAST_SOURCES", -1)
    assert {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()} == want == brute(rows, [("a", "train"), ("b", "test")])


def counted(rows):
    have = [(i, s == "a", split_words(t)) for i, s, t in rows]
    near = lambda a, b: O.word_distance(a, b, n := (max(len(a), len(b)) - 1) // 5) <= n
    return {(i, j) for i, t, a in have for j, u, b in have if t and not u and near(a, b)}


def test_group_of_near_copies_equals_brute_force(spark):
    """Runs that nearly all records hold, in records with many runs of their own, and records made mostly of one passage."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(165)]
    rows = [(i, "ab"[i % 2], " ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.05 else w for w in base)) for i in range(300)]
    form = [f"form{i}" for i in range(150)]
    rows += [(1000 + i, "ab"[i % 2], " ".join(form + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([30, 34, 36, 40, 60]))])) for i in range(160)]
    df, r = trajectories(spark, rows), spark.createDataFrame([("a", "train"), ("b", "test")], RESOLVED)
    got, want = {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()}, counted(rows)
    assert got == want and sum(i < 1000 for i, _ in want) > 20_000 and sum(i >= 1000 for i, _ in want) > 500


def test_evenly_spread_differences(spark):
    """Every 6th or 7th word changed leaves no common run of 8 words, at any length."""
    rows, n = [], 0
    for size in (40, 188, 200, 400, 1000):
        for step in (6, 7):
            base = [f"s{size}x{step}x{i}" for i in range(size)]
            for side, text in (("a", base), ("b", [f"c{i}" if i % step == 2 else w for i, w in enumerate(base)]), ("b", base + [f"t{i}" for i in range(size // 5)])):
                rows.append((n, side, " ".join(text)))
                n += 1
    df, r = trajectories(spark, rows), spark.createDataFrame([("a", "train"), ("b", "test")], RESOLVED)
    got, want = {(x.train_id, x.held_id) for x in O.overlaps(df, r).collect()}, counted(rows)
    assert got == want and len(want) == 20


def test_coverage_counts_what_the_pairs_say(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(60):
        words = list(base[i % 3])
        if i % 4 == 0:
            words[i % 60] = "edit"
        rows.append((i, ("t/a", "v/a", "v/b", "both/x")[rng.randrange(4)], " ".join(words)))
    df = trajectories(spark, rows)
    splits = spark.createDataFrame([("t/a", "train"), ("v/a", "validation"), ("v/b", "Test "), ("both/x", "train"), ("both/x", "test")], "source_id STRING, split STRING")
    want: dict = {}
    for r in O.overlaps(df, splits).collect():
        want.setdefault((r.held_id, r.held_split), []).append(r)
    got = {(r.held_id, r.held_split): r for r in O.held_coverage(df, splits).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k, rs in want.items():
        assert got[k].partners == len({r.train_id for r in rs}) and abs(got[k].similarity - sum(r.similarity for r in rs) / len(rs)) < 1e-9
    assert O.held_coverage(df.limit(0), splits).count() == 0
