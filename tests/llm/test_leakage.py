import random

import numpy as np

from sparkloom.llm import leakage as L
from sparkloom.llm.canonical import canonical_form
from sparkloom.llm.words import WordHashes, mix, shingles, split_words

DOCS, ITEMS = "doc_id BIGINT, text STRING", "case_id STRING, task STRING"


def test_words():
    assert split_words("Foo_bar-9 ÄÖ x2") == ["foo", "bar", "9", "äö", "x2"] and split_words("") == []
    assert len(shingles(WordHashes().of(["a"] * 4), 5)) == 0


def test_fingerprints_equal_a_plain_vote():
    rng = np.random.default_rng(0)
    marks = mix(rng.integers(0, 1 << 62, 40).astype(np.uint64))
    for per in (1, 3, 8):
        got = L.fingerprints(marks, per)
        for i, g in enumerate(got):
            bits = np.unpackbits(marks[i : i + per].view(np.uint8).reshape(-1, 8), axis=1)
            assert g == np.packbits(bits.sum(0) * 2 >= per).view(np.uint64)[0]


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in range(400))
    index = L.ItemIndex([("a", text)], 12, 5, 3)
    base = index.prints[rng.integers(0, index.size, 300)]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)], np.uint64)
    probe = base ^ flips
    got = set(zip(*(x.tolist() for x in index.near(probe))))
    assert got == {(i, j) for i, p in enumerate(probe) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= 3}


def test_weighted_similarity():
    a, b = np.array([[1, 1, 2, 3]], np.uint64), np.array([[1, 2, 2, 4]], np.uint64)
    assert np.isclose(L.similarity(a, b)[0], 2 / 6) and L.similarity(a, a)[0] == 1


def brute(docs, items, n=12):
    words = lambda t: split_words(canonical_form(t)) if t else []
    grams = {c: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for c, t in items if (w := words(t)) or True}
    return {(i, c) for i, t in docs for c, g in grams.items() if i is not None and c is not None and any(tuple(words(t)[k : k + n]) in g for k in range(len(words(t)) - n + 1))}


def test_exact_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)] + ["naïve", "x_y", "ＡＢ"]
    task = [[rng.choice(vocab) for _ in range(rng.choice([5, 12, 30, 80, 80]))] for _ in range(12)]
    items = [(f"c{i}", " ".join(t)) for i, t in enumerate(task)] + [("none", None), ("blank", " "), (None, " ".join(task[3]))]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(60)]
    for i in range(60, 160):
        t = rng.choice(task)
        k, n = rng.randrange(len(t)), rng.choice([11, 12, 13, 40, 40])
        docs.append((i, "filler " * rng.randrange(4) + "\r\n".join(t[k : k + n]).upper() + " end" * rng.randrange(20)))
    docs += [(200, None), (201, ""), (202, " ".join(task[-1] * 3)), (None, "x")]
    d, e = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = lambda d, e, **k: {(r.doc_id, r.case_id) for r in L.leaked_items(d, e, **k).where("exact_windows > 0").collect()}
    want = brute(docs, items)
    assert found(d, e) == want and len(want) > 20
    assert found(d.union(d).selectExpr("*", "'q' AS case_id", "1 AS windows"), e.union(e).selectExpr("*", "2 AS doc_id")) == want
    assert found(d, e, windows_per_pass=60) == want  # the items in several passes
    assert found(d.limit(0), e) == set() and found(d, e.limit(0)) == set()


def test_near_leak_and_long_document(spark):
    words = [f"t{i}" for i in range(40)]
    near = words[:14] + ["changed"] + words[15:]
    long = ["pad"] * 40_000 + words + ["pad"] * 20_000
    d = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(long)), (3, " ".join(words[::-1]))], DOCS)
    got = {r.doc_id: r for r in L.leaked_items(d, spark.createDataFrame([("c", " ".join(words))], ITEMS)).collect()}
    assert set(got) == {1, 2} and got[2].exact_windows == 29 and got[1].exact_windows == 3 + 14 and got[1].similarity == 1.0


def test_part_distance_and_items_of_any_size(spark):
    rng = random.Random(8)
    for _ in range(200):
        a, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (9, 20))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(a, 1):
            last = row
            row = [i]
            for j, y in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert L.part_distance(a, t) == min(row)
    words = [f"t{i}" for i in range(60)]
    dozen = [f"other{i}" if i % 12 == 5 else w for i, w in enumerate(words)]
    fifth = [f"other{i}" if i % 4 == 1 else w for i, w in enumerate(words)]
    docs = [(1, " ".join(["pad"] * 50 + dozen + ["pad"] * 30)), (2, " ".join(fifth)), (3, "see SHORT task, here"), (4, "short other task here"), (5, " ".join(words[::-1]))]
    d, e = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("long", " ".join(words)), ("short", "short task here"), ("none", " ")], ITEMS)
    got = {(r.doc_id, r.case_id): r for r in L.leaked_items(d, e).collect()}
    assert set(got) == {(1, "long"), (3, "short")} and np.isclose(got[1, "long"].similarity, 55 / 60) and got[1, "long"].exact_windows == 0
