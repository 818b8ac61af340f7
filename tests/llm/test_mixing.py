import math
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm import mixing as M

positive = st.floats(0.01, 100)


@given(st.lists(st.tuples(positive, st.floats(0, 1000)), min_size=1, max_size=20), st.floats(0.1, 5000))
def test_water_filling(rows, total):
    w, caps = zip(*rows)
    got = M.water_fill(list(w), list(caps), total)
    assert all(0 <= g <= c * (1 + 1e-9) for g, c in zip(got, caps))
    assert math.isclose(sum(got), min(total, sum(caps)), rel_tol=1e-6, abs_tol=1e-6)
    level = [g / x for g, x, c in zip(got, w, caps) if g < c * (1 - 1e-9)]
    if level:
        assert max(level) <= min(level) * (1 + 1e-6)  # all that are not at their cap stand at one level
        assert all(g / x <= min(level) * (1 + 1e-6) + 1e-9 for g, x, c in zip(got, w, caps))


def test_plan_and_draw(spark):
    sizes = spark.createDataFrame([(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 10) for i in range(100)] + [(3000, "other", 99), (3001, None, 5)], "doc_id BIGINT, feed STRING, tokens BIGINT")
    targets = spark.createDataFrame([(" A", 0.5, 3), ("b", 0.4, 2), ("gone", 0.1, 2), ("b", 0.3, 9), (None, 0.2, 1), ("neg", -0.1, 1), ("nan", float("nan"), None)], "source STRING, target_share DOUBLE, max_repeats INT")
    plan = {r.feed: r for r in M.mix_plan(sizes, targets).collect()}
    assert set(plan) == {"a", "b", "gone", "neg", "nan"}
    assert {f: r.reachable for f, r in plan.items()} == {"a": True, "b": False, "gone": False, "neg": True, "nan": True}
    assert plan["a"].source == " A" and plan["b"].mixed_tokens == 2000 and plan["b"].max_repeats == 2 and math.isclose(plan["a"].mixed_tokens, 9000) and math.isclose(plan["a"].actual_share, 9 / 11)
    drawn = M.draw(sizes, M.mix_plan(sizes, targets), seed=5).collect()
    assert {r.copies for r in drawn if r.feed == "b"} == {2} and sum(r.feed == "b" for r in drawn) == 100
    assert {r.copies for r in drawn if r.feed == "a"} == {1} and 850 < sum(r.feed == "a" for r in drawn) < 950
    assert sorted(tuple(r) for r in M.draw(sizes, M.mix_plan(sizes, targets), seed=5).collect()) == sorted(tuple(r) for r in drawn)
    assert M.mix_plan(sizes, targets.limit(0)).count() == 0 and M.draw(sizes.limit(0), M.mix_plan(sizes.limit(0), targets)).count() == 0


@pytest.mark.skipif(not os.path.isdir(M.TOKENIZER_DIR), reason="no vocabulary files here")
def test_sizes(spark):
    d = spark.createDataFrame([(1, "hello world", " Feed/A ", 1), (2, None, "feed/a", 1), (3, " \n", None, 1), (4, "", " ", 1), (5, "x y\n" * 60_000, "é", 1)], "doc_id BIGINT, text STRING, source STRING, tokens INT")
    got = {r.doc_id: (r.feed, r.tokens) for r in M.token_sizes(d).collect()}
    assert got[1] == ("feed/a", 2) and got[2] == ("feed/a", 0) and got[3] == (None, 0) and got[4] == (None, 0) and got[5][0] == "é"
    encode = M.encoding(os.path.join(M.TOKENIZER_DIR, M.VOCABULARY)).encode_ordinary
    assert got[5][1] == len(encode("x y\n" * 60_000))
    assert M.count_tokens(encode, "a" * 300_000) > 0


def test_whole_texts_are_counted_in_pieces():
    import os
    import random

    import pytest

    path = os.path.join(M.TOKENIZER_DIR, M.VOCABULARY)
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    encode, rng = M.encoding(path).encode_ordinary, random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "\n\n", "12", "'s", "é", "—", "\t", "(x)", "\r\n"]) for _ in range(5000))
    assert len({M.count_tokens(encode, text, n) for n in (10, 100, 1000, 1 << 20)}) == 1


def test_reachable_comes_from_the_allocation(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 890)], "feed STRING, tokens BIGINT")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.1, 10), ("c", 0.4, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    got = {r.source: (r.reachable, r.mixed_tokens) for r in M.mix_plan(sizes, targets).collect()}
    assert [got[x][0] for x in "abc"] == [False, True, True] and got["a"][1] == 400 and abs(got["b"][1] - 100) < 1e-6
