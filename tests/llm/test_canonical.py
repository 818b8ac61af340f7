import random

from sparkloom.llm import canonical as C

PAIRS_ALIKE = [
    ("naïve café", "naïve café"), ("ＡＢＣ１２", "ABC12"), ("a b c　d", "a b c d"), ("ze​ro w‍id­th﻿", "zero width"),
    ("раypal", "paypal"), ("οpen", "open"), ("ﬁle ﬂow oﬀ", "file flow off"), ("Å", "Å"), ("ё", "ë"),
]
PAIRS_DIFFERENT = [("a\r\nb", "a\nb"), ("cafe", "café"), ("A", "a"), ("x²", "x2"), ("й", "и"), ("10", "I0"), ("a  b", "a b"), ("ß", "ss"), ("a\tb", "a b")]


def test_forms():
    for a, b in PAIRS_ALIKE:
        assert C.canonical_form(a) == C.canonical_form(b) and C.look_form(a) == C.look_form(b), (a, b)
    for a, b in PAIRS_DIFFERENT:
        assert C.look_form(a) != C.look_form(b), (a, b)
    assert C.canonical_form("STRASSE") == C.canonical_form("straße")  # full case folding


def test_forms_are_stable_and_whole():
    rng = random.Random(1)
    alphabet = "abc XYZ09éàё́̈а​ ﬁＡ　ßİ²\n\rΣσ"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert C.canonical_form(C.canonical_form(t)) == C.canonical_form(t)
        assert C.look_form(C.look_form(t)) == C.look_form(t)
        assert C.look_form(t) == C.Forms()._look_run(t)  # mapping run by run equals mapping the whole text
    long = ("а" * 50 + "x ") * 20_000
    assert C.canonical_form(long) == ("a" * 50 + "x ") * 20_000


def test_confusables_of_other_scripts(spark):
    forms = C.forms_for(spark)
    for letter, latin in {"օ": "o", "Ꭺ": "A", "ꓐ": "B", "ᴄ": "c", "Ϲ": "C", "ɑ": "a", "ꭇ": "r"}.items():
        assert forms.look(f"x{letter}y") == f"x{latin}y" and forms.canonical(letter) == latin.lower(), letter
    for kept in ("г", "σ", "𝐀", "’", "—", "é", "l1I0O"):
        assert forms.look(kept) == kept
    assert forms.canonical("a\tb\u2028c\x85d") == "a b\nc\nd" and forms.look("a\u2028b") != forms.look("a\nb")
    import pickle

    assert pickle.loads(pickle.dumps(forms.look))("օ") == "o"


def frame(spark, texts, extra=False):
    if extra:
        return spark.createDataFrame([(i, t, "k", "l", i) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, canonical_key STRING, id STRING, a BIGINT")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


def test_pairs_equal_brute_force(spark):
    texts = [None, "", " ", "​", "same", "same", "sаme", "ｓame", "SAME", "other", "sa‍me", "othér", None]
    for extra in (False, True):
        got = {(r.doc_a, r.doc_b) for r in C.lookalike_pairs(frame(spark, texts, extra)).collect()}
        want = {(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a and b and not C.is_blank(C.look_form(a)) and a != b and C.look_form(a) == C.look_form(b)}
        assert got == want and (4, 6) in got and (4, 5) not in got
    assert C.lookalike_pairs(frame(spark, [])).count() == 0


def test_hot_text_and_repeated_rows(spark):
    texts = ["hot text"] * 300 + ["hоt text"]
    df = frame(spark, texts)
    assert {(r.doc_a, r.doc_b) for r in C.lookalike_pairs(df.union(df)).collect()} == {(i, 300) for i in range(300)}


def test_column_and_classes(spark):
    df = frame(spark, ["Ａ", "a", None, "b", ""]).withColumnRenamed("text", "t")
    out = {r.doc_id: r.canonical_text for r in C.with_canonical(df.selectExpr("*", "'x' AS canonical_text"), "t").collect()}
    assert out == {0: "a", 1: "a", 2: None, 3: "b", 4: ""}
    assert {tuple(r) for r in C.canonical_classes(df, text_col="t").collect()} == {(0, 0, 2, 2), (1, 0, 2, 2)}
