"""Scalar functions against literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import references as r
from glossa.functions import text as t
from glossa.functions import urls as u


def values(spark, rows, make):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)])
    return [x[0] for x in df.select("_1", make(df).alias("v")).orderBy("_1").select("v").collect()]


def test_norm_key(spark):
    assert values(spark, ["lǜ", "lu:4", "110", " Píng guǒ ", "APPLE", "it's a-b", ""], lambda d: t.norm_key(F.col("_2"))) == ["lv", "lv", "110", "pingguo", "apple", "itsab", ""]


@pytest.mark.parametrize(("raw", "want"), [("liu2 shui3 xue2 lv4 dou1", "liú shuǐ xué lǜ dōu"), ("Zhong1", "Zhōng"), ("ma5", "ma"), ("b1", "b")])
def test_tone_marks(raw, want):
    assert t.mark_tones(raw) == want


def test_tone_marks_column(spark):
    assert values(spark, ["nu:3 er2", None], lambda d: t.tone_marks(F.col("_2"))) == ["nǚ ér", None]


def test_norm_terms_keeps_words_apart(spark):
    assert values(spark, ["rendah　hati", "rendahhati", "A-b_c!"], lambda d: t.norm_terms(F.col("_2"))) == ["rendah hati", "rendahhati", "a b c"]


def test_near(spark):
    pairs = [("anjing", "anjnig"), ("anjing", "anjin"), ("anjing", "anjang"), ("anjing", "anjing"), ("abc", "cba"), ("ab", "abcd")]
    assert values(spark, pairs, lambda d: t.near(F.col("_2"), F.col("_3"))) == [True, True, True, False, False, False]


def test_grams(spark):
    assert values(spark, ["abcabc", "ab", ""], lambda d: t.grams(F.col("_2"))) == [["abc", "bca", "cab"], [], []]


def test_gloss_and_parts(spark):
    assert values(spark, ["The human　 being.", "to run"], lambda d: t.norm_gloss(F.col("_2"))) == ["human being", "run"]
    assert values(spark, ["a (b;c); fig. d / e"], lambda d: t.alternatives(F.col("_2"))) == [["fig. d"]]
    assert values(spark, ["x (a (b)) y"], lambda d: t.without_parentheses(F.col("_2"))) == ["x y"]
    assert values(spark, ["N", "adverb", "noun"], lambda d: t.norm_pos(F.col("_2"))) == ["noun", "adv", "noun"]


def brackets(seed, n=60):
    rng = random.Random(seed)
    rows = ["".join(rng.choice("(()) ab;/") for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return rows + ["a " + "(" * 50 + "x" + ")" * 50 + " b", "(" * 50, ")" * 50, "a (b; c; d; e) f; g", "", "((a) b", "a) (b"]


def test_nested_parentheses_at_any_depth(spark):
    def removed(s):
        before = None
        while before != s:
            before, s = s, re.sub(r"\([^()]*\)", " ", s)
        return " ".join(s.split())

    rows = brackets(1)
    assert values(spark, rows, lambda d: t.without_parentheses(F.col("_2"))) == [removed(s) for s in rows]


def test_alternatives_with_many_separators(spark):
    def split(s):
        return [x.strip() for x in re.split("[;/]", re.sub(r"\([^)]*\)", lambda m: re.sub("[;/]", ",", m.group()), s)) if x.strip()]

    rows = brackets(2)
    assert values(spark, rows, lambda d: t.alternatives(F.col("_2"))) == [split(s) for s in rows]
    assert split("a (b; c; d; e) f; g") == ["a (b, c, d, e) f", "g"]


def test_participles(spark):
    words = ["lie", "rev", "bus", "dye", "toe", "run", "see", "make", "fix", "play", "read"]
    assert values(spark, words, lambda d: t.participle(F.col("_2"))) == ["lying", "revving", "bussing", "dying", "toing", "running", "seeing", "making", "fixing", "playing", "reading"]


def test_references(spark):
    rows = [("variant of 个|個[ge4]", "bentuk lain daripada X.", "alternative written form of X"), ("see 个[ge4]", "Lihat KANJIANREF", "see KANJIANREF"), ("abbr. for 个[ge4]", "• singkatan untuk 个[ge4].", "abbr. for 个[ge4]"),
        ("variant of 个[ge4]", "varian bagi Y", "alternative written form of X"), ("variant of a[ge4]", "varian X", "alternative written form of X"), ("variant of 个[ge4], old", "varian X", "alternative written form of X"), ("see 个[ge4]", "lihat X", "look at X"), (None, "lihat X", "see X")]
    got = values(spark, rows, lambda d: r.restore(F.col("_2"), F.col("_3"), F.col("_4")))
    assert [x and (x.kind, x.reference, x.definition) for x in got] == [("variant", "个|個[ge4]", "Varian bagi 个|個[ge4]."), ("see", "个[ge4]", "Lihat 个[ge4]."), ("abbreviation", "个[ge4]", "Singkatan bagi 个[ge4]."), None, None, None, None, None]


def test_bounded_query_stops_at_the_first_word_that_does_not_fit(spark):
    words = ["a" * 60, "b" * 60, "c"]
    assert values(spark, [" ".join(words)], lambda d: t.bounded_query(F.split("_2", " "))) == ["a" * 60]


def test_urls(spark):
    rows = ["https://www.a.org/x/?utm_source=1&b=2&a=1", "https://a.org/p_640.jpg?w=3", "http://a.org/", "https://localhost/x", "https://u@a.org/"]
    assert values(spark, rows[:1], lambda d: u.source_identity(F.col("_2"))) == ["a.org/x?a=1&b=2"]
    assert values(spark, rows[1:2], lambda d: u.image_identity(F.col("_2"))) == ["a.org/p.jpg"]
    assert values(spark, rows, lambda d: u.is_public_https(F.col("_2"))) == [True, True, False, False, False]
    assert values(spark, ["", "a", "foobar"], lambda d: u.fnv1a(F.col("_2"))) == [2166136261, 3826002220, 3214735720]
