"""Text functions and metrics against golden vectors and plain definitions."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkeval.functions.metrics import first_reference, lcs_length, with_bleu, with_rouge_l, with_rouge_n, with_sari
from sparkeval.functions.text import extract, is_blank, space_tokens, strip, truncate, usable, without_leading_number, word_tokens

BLEU = [
    ("a b c d e", "a b c d e", 100, 100, 100, 100, 100),
    ("a b c", "a b c", 100, 100, 100, 0, 0),
    ("the cat sat on the mat", "the the the cat", 45.4898, 20.2177, 0, 0, 0),
    ("a b c d", "a b c d e f", 66.6667, 60, 50, 33.3333, 50.8133),
    ("a b c d e f", "a b c d", 60.6531, 60.6531, 60.6531, 60.6531, 60.6531),
    ("x y", "", 0, 0, 0, 0, 0),
    (None, "x", 0, 0, 0, 0, 0),
]
ROUGE = [("a b c d e", "a b c d e", 1, 1, 1), ("a", "a", 1, 0, 1), ("the cat sat on the mat", "the the cat mat", 0.8, 0.25, 0.6), ("a b c", "c b a", 1, 0, 0.3333), ("a b", "", 0, 0, 0), ("...", "a", 0, 0, 0)]
SARI = [
    ("a b c d e", ["a b c d e"], "a b c d e", 33.3333), ("a b c d e", ["a b x"], "a b x", 75), ("a b c d e", ["a b x"], "", 30.0595),
    ("a b c d e", ["a b x", "a y"], "a b y", 55.5556), ("a b c d e", ["a b x", "a y"], "a b c d e", 8.0952), ("a b", ["a"], "a", 25), ("a b", [" ", None], "a", 0),
]


def test_bleu_vectors(spark):
    df = spark.createDataFrame([(i, r, p) for i, (r, p, *_) in enumerate(BLEU)], "i int, r string, p string")
    got = {x.i: x for x in with_bleu(df, "r", "p").collect()}
    for i, (_, _, *scores) in enumerate(BLEU):
        assert [got[i][c] for c in ("bleu_1", "bleu_2", "bleu_3", "bleu_4", "bleu_overall")] == pytest.approx(scores, abs=1e-3)


def test_rouge_vectors(spark):
    df = spark.createDataFrame([(i, r, p) for i, (r, p, *_) in enumerate(ROUGE)], "i int, r string, p string")
    got = {x.i: x for x in with_rouge_l(with_rouge_n(df, "r", "p"), "r", "p").collect()}
    for i, (_, _, *scores) in enumerate(ROUGE):
        assert [got[i][c] for c in ("rouge1", "rouge2", "rougeL")] == pytest.approx(scores, abs=1e-4)


def test_sari_vectors(spark):
    df = spark.createDataFrame([(i, s, *(r + [None] * 2)[:2], p) for i, (s, r, p, _) in enumerate(SARI)], "i int, s string, r1 string, r2 string, p string")
    got = {x.i: x.sari for x in with_sari(df, "s", ["r1", "r2"], "p").collect()}
    flipped = {x.i: x.sari for x in with_sari(df, "s", ["r2", "r1", "r1"], "p").collect()}
    for i, (*_, score) in enumerate(SARI):
        assert got[i] == pytest.approx(score, abs=1e-4) and flipped[i] == pytest.approx(score, abs=1e-4)


def test_lcs_against_definition():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randint(0, 12)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]


TEXTS = ["සිංහල", "தமிழ்", "hello_world 12½ x²", "it's", "...!!", None, "", "  a b c\x1cd\r\n e ", "A\u0085B"]


def test_tokens_like_the_standard_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for x in df.select("i", word_tokens("t").alias("w"), space_tokens("t").alias("s"), strip("t").alias("p"), is_blank("t").alias("b")).collect():
        t = TEXTS[x.i]
        assert x.w == ([] if t is None else re.findall(r"\w+", t.lower()))
        assert x.s == ([] if t is None else t.split())
        assert x.p == (None if t is None else t.strip()) and x.b == (t is None or not t.strip())


RESPONSES = [
    ("Translation: abc \nsecond", "abc ", "abc \nsecond", "abc \nsecond"),
    ("translation:\n\nabc\n\ndef", "translation:\n\nabc\n\ndef", "translation:\n\nabc\n\ndef", "abc"),
    ("Translation: one\nTranslation: two\n\n", "one", "one\nTranslation: two", "one\nTranslation: two"),
    ("no marker  ", "no marker", "no marker", "no marker"),
    ("Translation:   ", "", "", ""),
    (None, "", "", ""),
]


def test_extraction_vectors(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RESPONSES)], "i int, r string")
    modes = ("first_line", "to_end", "paragraph")
    for x in df.select("i", *[extract("r", "Translation:", m).alias(m) for m in modes]).collect():
        assert tuple(x[m] for m in modes) == RESPONSES[x.i][1:]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("12 a b", "x" * 600, None, " ", "r")], "n string, l string, a string, b string, c string")
    x = df.select(without_leading_number("n").alias("n"), truncate("l").alias("l"), usable("a", "b", "c").alias("u"), first_reference("a", "b", "c").alias("f")).first()
    assert x.n == "a b" and x.l == "x" * 500 + "..." and x.u == ["r"] and x.f == "r"


def test_bleu_by_definition_on_random_texts(spark):
    import math
    import random

    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(1, 12))), " ".join(r.choices("abc", k=r.randint(1, 12)))) for i in range(60)]
    got = {x.i: x for x in with_bleu(spark.createDataFrame(rows, "i int, r string, p string").repartition(5), "r", "p").collect()}
    for i, ref, pred in rows:
        a, b = ref.split(), pred.split()
        bp = 1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b))
        shares = []
        for n in (1, 2, 3, 4):
            x, y = (Counter(zip(*[t[k:] for k in range(n)])) for t in (a, b))
            shares.append(sum((x & y).values()) / max(1, sum(y.values())))
            assert got[i][f"bleu_{n}"] == pytest.approx(100 * bp * shares[-1])
        want = 100 * bp * math.prod(shares) ** 0.25 if min(shares) > 0 else 0
        assert got[i].bleu_overall == pytest.approx(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "r string, p string")
    assert with_bleu(df, "r", "p").count() == 0 and with_rouge_l(df, "r", "p").count() == 0
    assert df.select(F.lit(1)).count() == 0
