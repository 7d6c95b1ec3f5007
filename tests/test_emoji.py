import random

import pytest
from pyspark.sql import functions as F

from moodmill.operators import emoji
from moodmill.operators.emoji import EmojiDictionary, FilterConfig
from moodmill.plans.preparation import labelled_tweets
from moodmill.plans.relations import EMOJIS, dictionary

TEXTS = [
    "a nice long text here 😂😂",
    "two kinds 😂 and 😍 in one text",
    "other one 🔥 and 😂 with it",
    "skin tone 👍🏽 in the middle",
    "👍 first and last 👍 of it",
    "heart ❤️ in a longer text",
    "bare heart ❤ in a longer text",
    "no emoji in this text",
    "😂",
    "abcd 😂",
    "abcde😂",
    "",
    "👍👍👍😭😭😭 tie of two kinds",
]


@pytest.fixture(params=["constant", "joined"])
def entries(request, spark, monkeypatch):
    """The dictionary as a constant of the plan, and as a table too large for that."""
    if request.param == "joined":
        monkeypatch.setattr(emoji, "CONSTANT_ENTRIES", 3)
    d = EmojiDictionary.of(dictionary(spark))
    assert (d.by_point is None) == (request.param == "joined")
    return d


def texts(spark, values=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "id int, text string")


def brute(values):
    return {
        (i, e, s, t.count(e)) for i, t in enumerate(values) for e, s in EMOJIS if t.count(e)
    }


def test_counts_equal_brute_force(spark, entries):
    rng = random.Random(5)
    parts = [e for e, _ in EMOJIS] + ["a", " ", "️", "🏽", "👎"]
    values = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    rows = emoji.emoji_counts_detailed(texts(spark, values), entries).collect()
    assert len(rows) == len(brute(values))
    assert {(r.id, r.emoji, r.is_64, r.n) for r in rows} == brute(values)
    labels = emoji.emoji_counts(texts(spark, values), entries).collect()
    assert {(r.id, r.emoji, r.n) for r in labels} == {(i, e, n) for i, e, s, n in brute(values) if s}


def test_removal_is_in_sorted_order(spark, entries):
    values = ["❤️x", "a👍🏽b", "👍😂👍", "plain"]
    rows = emoji.remove64_emojis(texts(spark, values), entries).orderBy("id").collect()
    assert [r.rest for r in rows] == ["x", "a🏽b", "", "plain"]


def test_removal_can_join_two_halves(spark):
    entries = spark.createDataFrame([("b", True), ("ac", True)], "emoji string, is_64 boolean")
    row = emoji.remove64_emojis(texts(spark, ["xabc"]), entries).first()
    assert row.rest == "xac"  # "ac" comes before "b" and has had its turn
    entries = spark.createDataFrame([("b", True), ("dc", True)], "emoji string, is_64 boolean")
    assert emoji.remove64_emojis(texts(spark, ["xdbc"]), entries).first().rest == "x"


def test_verdicts(spark, entries):
    rows = emoji.emoji_verdict(texts(spark), entries).orderBy("id").collect()
    assert [r.reject_reason for r in rows] == [
        None, "several_types", "other_emoji", "other_emoji", None, "other_emoji", "no_emoji", "no_emoji",
        "too_short", None, None, "no_emoji", "several_types",
    ]
    assert (rows[0]["class"], rows[0]["count"]) == ("😂", 2)
    assert (rows[4]["class"], rows[4]["count"]) == ("👍", 2)
    assert (rows[7]["class"], rows[7]["count"]) == (None, None)
    assert (rows[12]["class"], rows[12]["count"]) == ("👍", 3)


def test_length_rule_needs_both_words_and_characters(spark, entries):
    values = ["abc😂", "a b c d e 😂", "a b 😂", "  😂", "abcde😂"]
    rows = emoji.emoji_filter(texts(spark, values), entries).orderBy("id").collect()
    assert [r.reject_reason for r in rows] == ["too_short", None, "too_short", "too_short", None]


def test_filter_options(spark, entries):
    loose = FilterConfig(only_one_type=False, exclude_non64=False, only_one64_block=True)
    rows = emoji.emoji_filter(texts(spark), entries, loose).orderBy("id").collect()
    assert [r.reject_reason for r in rows] == [
        None, None, None, None, "several_blocks", None, "no_emoji", "no_emoji", "too_short", None, None, "no_emoji", None,
    ]


def test_single_block(spark):
    df = spark.createDataFrame([("👍 x 👍",), ("👍👍 x",), ("⁂ 👍",), ("x",)], "t string")
    got = [r[0] for r in df.select(emoji.emoji_single_block(F.col("t"), F.lit("👍"))).collect()]
    assert got == [False, True, False, True]


def test_non64(spark):
    assert {r.emoji for r in emoji.emojis_non64(dictionary(spark)).collect()} == {"❤", "🔥", "👍🏽"}


def test_empty_dictionary(spark):
    none = dictionary(spark).where(F.lit(False))
    assert emoji.emoji_counts_detailed(texts(spark), none).count() == 0
    assert emoji.emoji_filter(texts(spark), none).where("reject_reason = 'no_emoji'").count() == len(TEXTS)


def test_labelled_tweets_by_hand(spark, entries):
    rows = [
        ("f1", "RT @x: a long enough text 😂 http://t.co/1"),
        ("f1", "a long enough text 😂"),
        ("f2", "a long enough text 😂"),
        ("f1", "nothing to see"),
        ("f1", "too 🔥 much 😂 of it all"),
    ]
    tweets = spark.createDataFrame(rows, "source_file string, text string")
    got = sorted(map(tuple, labelled_tweets(tweets, entries).collect()))
    assert got == [("f1", "a long enough text 😂", "😂", 1), ("f2", "a long enough text 😂", "😂", 1)]
    every = labelled_tweets(tweets, entries, scope="all").collect()
    assert [tuple(r) for r in every] == [("a long enough text 😂", "😂", 1)]


def test_preparation_shuffles_once(spark):
    tweets = spark.createDataFrame([("f", "a long enough text 😂")], "source_file string, text string")
    plan = labelled_tweets(tweets, dictionary(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_repeated_entries_are_one(spark):
    entries = spark.createDataFrame([("😂", False), ("😂", True), ("🔥", False), ("🔥", False)], "emoji string, is_64 boolean")
    texts = spark.createDataFrame([("a 😂 😂 🔥",)], "text string")
    got = emoji.emoji_counts_detailed(texts, entries).collect()
    assert sorted((r.emoji, r.is_64, r.n) for r in got) == sorted([("🔥", False, 1), ("😂", True, 2)])


def test_only_short_texts_are_split_into_words(spark):
    """the rule for short texts looks at the length first; what it refuses stays the same."""
    dictionary = spark.createDataFrame([("😂", True)], "emoji string, is_64 boolean")
    rests = {"": "too_short", "abcd": "too_short", "abcde": None, "a b ": "too_short", "a b c": None, "    ": None, "ab cd ef": None}
    df = spark.createDataFrame([("😂" + r,) for r in rests], "text string")
    verdict = emoji.emoji_verdict(df, dictionary)
    assert {r.text[1:]: r.reject_reason for r in verdict.collect()} == rests
    plan = verdict.select("reject_reason")._jdf.queryExecution().optimizedPlan().toString()
    reason = plan[: plan.index("too_short")]
    assert "split(" in reason and reason.rindex("length(") < reason.rindex("split(")
