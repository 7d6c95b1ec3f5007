import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from moodmill.functions import text as clean

# (operator, raw text, expected text), worked out by hand.
CASES = [
    ("remove_control_chars", "one\ntwo\tthree\x85", "onetwothree"),
    ("remove_control_chars", "", ""),
    ("remove_links", "see http://t.co/x now", "see  now"),
    ("remove_links", "xhttp://a b", "x b"),
    ("remove_links", "http://a　rest", "rest"),
    ("remove_links", " \xa0 http://only ", ""),
    ("remove_tags", "RT @u5: hello #tag you", "hello you"),
    ("remove_tags", "ART x", "Ax"),
    ("remove_tags", "a &amp; b &lt;c&gt; &br;d", "a b c d"),
    ("remove_tags", "#a @b", ""),
    ("remove_tags", "mail@host x#y", "mail@host x#y"),
    ("remove_tags", "", ""),
    ("trim_string", "  a 　 b c\x1d\x1cd ", "a b c d"),
    ("space_punctuation", "it's, (a) test...", "it s a test"),
    ("space_punctuation", "!!!", ""),
    ("remove_non_printed_chars", "aé\\b яЁ ❤", "a  b яЁ  "),
    ("process_text", "One. Two, three é four", "OneTwothree four"),
    ("process_text_dataset", "It's HERE!", "it s here"),
    ("process_tweets", "RT @u: so\ngood!! http://t.co/a #x 😂😂", "sogood 😂😂"),
    ("process_tweets", "", ""),
]


def test_cleaning_cases(spark):
    names = sorted({op for op, _, _ in CASES})
    df = spark.createDataFrame(CASES, "op string, raw string, expected string")
    got = F.coalesce(*[F.when(F.col("op") == n, getattr(clean, n)(F.col("raw"))) for n in names])
    wrong = df.withColumn("got", got).where(~F.col("got").eqNullSafe(F.col("expected"))).collect()
    assert wrong == []


def test_smileys_are_kept_and_cut(spark):
    raw = ["!!!!!!hi:) ok...", "", ":-)", "a", "x????y"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    four = [r[0] for r in df.select(clean.space_punctuation(F.col("raw"), remove=False)).collect()]
    assert four == ["!!!! hi :) ok ...", "", ":-)", "a", "x ???? y"]
    none = [r[0] for r in df.select(clean.space_punctuation(F.col("raw"), False, 0)).collect()]
    assert none == ["! hi : ok .", "", ":", "a", "x ? y"]


def test_predicates(spark):
    df = spark.createDataFrame([("a.b",), ("ab",), ("",), ("\\",)], "t string")
    rows = df.select(clean.has_punctuation(F.col("t")), clean.str_contains("b", F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, True), (False, False), (True, False)]


def test_every_punctuation_character_is_removed(spark):
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    df = spark.createDataFrame([(f"a{m}b",) for m in marks], "t string")
    assert {r[0] for r in df.select(clean.space_punctuation(F.col("t"))).collect()} == {"a b"}


@pytest.fixture(scope="module")
def cleaned_twice(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        once = clean.process_tweets(F.col("t"))
        out = df.select("t", once.alias("c"), clean.trim_string(once).alias("d"), clean.trim_string(F.col("t")).alias("s"))
        return out.collect()

    return run


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab @#&;.\n\t　\xa0http:/RT😂é", max_size=40), min_size=1, max_size=30))
def test_cleaned_text_is_stable(cleaned_twice, texts):
    for row in cleaned_twice(texts):
        assert row.c == row.d
        assert not re.search(r"[!-/:-@\[-`{-~\n\t]", row.c)
        assert row.s == " ".join(row.t.split())
