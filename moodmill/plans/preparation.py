"""The tweet preparation as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moodmill.functions.text import process_tweets
from moodmill.operators.dedup import dedup
from moodmill.operators.emoji import EmojiDictionary, FilterConfig, emoji_verdict
from moodmill.operators.language import LanguageModel, language_predict
from moodmill.session import durable


def labelled_tweets(
    tweets: DataFrame,
    dictionary: DataFrame | EmojiDictionary,
    config: FilterConfig = FilterConfig(),
    scope: str = "file",
) -> DataFrame:
    """``source_file, text, class, count`` of the cleaned, kept and distinct texts.

    Texts without any code point of a label emoji leave before they are cleaned.
    Cleaning, counting and filtering are projections; the distinct is the one
    shuffle, and only kept texts reach it.
    """
    d = EmojiDictionary.of(dictionary)
    raw = tweets.select("source_file", "text").where(d.may_hold_label(F.col("text")))
    # The one-element explode has each text cleaned once.
    cleaned = raw.select("source_file", F.explode(F.array(process_tweets(F.col("text")))).alias("text"))
    kept = emoji_verdict(cleaned, d, config).where(F.col("reject_reason").isNull())
    return dedup(kept.select("source_file", "text", "class", "count"), scope, dependent=("class", "count"))


def prepare(
    tweets: DataFrame,
    dictionary: DataFrame | EmojiDictionary,
    languages: LanguageModel,
    config: FilterConfig = FilterConfig(),
    with_source: bool = False,
) -> DataFrame:
    """Prepared rows ``text, lang, prob, class, count``, distinct per source file.

    ``with_source`` puts ``source_file`` first; the training frame makes its row ids from it,
    so that a text of two files stays two rows.

    The kept texts are written once; the language prediction reads them several times.
    """
    labelled = durable(labelled_tweets(tweets, dictionary, config), "labelled")
    source = ["source_file"] if with_source else []
    return language_predict(labelled, languages).select(*source, "text", "lang", "prob", "class", "count")
