"""From a training frame to encoded samples, features and a scored classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from moodmill.functions.tokens import NO_STRINGS, pad_sequence, pad_words, plain_text_split, sequence_length
from moodmill.operators.classifier import classifier_fit, classifier_predict
from moodmill.operators.embeddings import (
    attach_word_vectors,
    category_embedding,
    category_width,
    embedding_lookup,
    word_vectors_attention,
    word_vectors_mean,
)
from moodmill.operators.evaluation import batch_metrics
from moodmill.operators.pooling import pool_attention, pool_attention_multi, pool_max, pool_mean
from moodmill.operators.splits import HOLDOUT_SHARE, SEED, holdout_split, split_mode
from moodmill.operators.subwords import subword_samples
from moodmill.operators.vocabulary import encode_ids, sequence_steps
from moodmill.session import durable

# Length of a padded text, the id of the padding, and the column with the group of a text.
MAX_LEN = 100
PAD_ID = 0
GROUP = "_group"


@dataclass(frozen=True)
class FeatureConfig:
    """How a text becomes one vector.

    ``embedding`` is ``'dict'`` (one id per word), ``'bpe'`` (one id per subword of the
    model ``subword_model``), ``'bag'`` (mean of n-gram vectors) or ``'wbag'`` (attention
    over n-gram vectors). ``pooling`` is
    ``'mean'``, ``'max'``, ``'attention'`` or ``'heads'``, one attention per entry
    of ``head_weights``.
    """

    embedding: str = "bag"
    pooling: str = "mean"
    max_len: int = MAX_LEN
    word_weights: tuple[float, ...] = ()
    step_weights: tuple[float, ...] = ()
    head_weights: tuple[tuple[float, ...], ...] = ()
    subword_model: bytes = b""


def encode_samples(
    df: DataFrame, keys: list[str], vocabulary: DataFrame, text: str = "processed",
    max_len: int = MAX_LEN, oov: str = "error",
) -> DataFrame:
    """``keys, ids, seq_len``: padded word indices of each text."""
    words = F.coalesce(plain_text_split(F.col(text)), F.expr(NO_STRINGS))
    if oov == "unk":
        words = F.slice(words, 1, max_len)  # what the padding would cut off is not encoded
    encoded = encode_ids(df.select(*keys, words.alias("tokens")), vocabulary, keys, oov=oov)
    return encoded.select(
        *keys,
        pad_sequence(F.col("ids"), max_len, F.lit(PAD_ID).cast("bigint")).alias("ids"),
        sequence_length(F.col("ids"), max_len).alias("seq_len"),
    )


def word_samples(df: DataFrame, keys: list[str], text: str = "processed", max_len: int = MAX_LEN) -> DataFrame:
    """``keys, words, seq_len``: padded words of each text, none of a null text; a projection."""
    words = F.coalesce(plain_text_split(F.col(text)), F.expr(NO_STRINGS))
    tokens = df.select(*keys, words.alias("_tokens"))
    return tokens.select(
        *keys,
        pad_words(F.col("_tokens"), max_len).alias("words"),
        sequence_length(F.col("_tokens"), max_len).alias("seq_len"),
    )


def vector_steps(
    df: DataFrame, keys: list[str], table: DataFrame, dim: int, config: FeatureConfig,
    text: str = "processed", oov: str = "error",
) -> DataFrame:
    """``keys, seq_len, pos, vector, times``: the steps of the padded texts.

    No pooling looks at the order of steps, so a word that stands several times in a
    text, as the padding does, is one step with its number as ``times``. Then ``pos`` and
    ``seq_len`` only say whether it is a word of the text (0 of 1) or padding (1 of 1). A further
    column ``_group`` deals the texts into groups whose steps lie together, so that sums over a text are not
    shuffled.
    """
    if config.embedding == "dict":
        samples = encode_samples(df, keys, table, text, config.max_len, oov)
        steps = embedding_lookup(sequence_steps(samples, "ids", "idx"), table).drop("idx")
        return steps.withColumn("times", F.lit(1))
    if config.embedding == "bpe":
        samples = subword_samples(df, keys, config.subword_model, text, config.max_len)
        steps = embedding_lookup(sequence_steps(samples, "ids", "idx"), table).drop("idx")
        return steps.withColumn("times", F.lit(1))
    if config.embedding == "bag":
        def vectors_of(words: DataFrame, group: str | None) -> DataFrame:
            return word_vectors_mean(words, table, dim, group=group)
    elif config.embedding == "wbag":
        def vectors_of(words: DataFrame, group: str | None) -> DataFrame:
            return word_vectors_attention(words, table, list(config.word_weights), dim, group=group)
    else:
        raise ValueError(f"unknown embedding {config.embedding!r}")
    padding = (F.col("pos") >= F.col("seq_len")).cast("int").alias("pos")

    def steps_of(samples: DataFrame) -> DataFrame:
        every = sequence_steps(samples, "words")
        return every.groupBy(GROUP, *keys, padding, "word").agg(F.count("*").alias("times"), F.lit(1).alias("seq_len"))

    # Written once: its words are listed, and then its steps meet their vectors.
    samples = durable(word_samples(df, keys, text, config.max_len).withColumn(GROUP, F.xxhash64(*keys)), "samples")
    return attach_word_vectors(samples, steps_of, vectors_of, dim, GROUP).drop("word")


def text_features(
    df: DataFrame, keys: list[str], table: DataFrame, dim: int, config: FeatureConfig = FeatureConfig(),
    text: str = "processed", oov: str = "error", categories: dict[str, tuple[DataFrame, int]] | None = None,
) -> DataFrame:
    """``keys, vector``: one pooled vector per text, with ``head`` for the pooling by heads.

    ``keys`` may carry further columns of a row, such as its target. ``categories`` maps
    key columns that hold codes to their tables, whose vectors are appended before the
    pooling. A text without steps has a null vector where padding does not count.
    """
    steps = vector_steps(df, keys, table, dim, config, text, oov)
    if categories:
        steps = category_embedding(steps, categories)
        dim += sum(category_width(size) for _, size in categories.values())
    if GROUP in steps.columns:
        keys = [GROUP, *keys]
    if config.pooling == "mean":
        return pool_mean(steps, keys, dim, times="times").drop(GROUP)
    if config.pooling == "max":
        return pool_max(steps, keys, dim).drop(GROUP)
    if config.pooling == "attention":
        return pool_attention(steps, keys, list(config.step_weights), dim, times="times").drop(GROUP)
    if config.pooling == "heads":
        return pool_attention_multi(steps, keys, [list(w) for w in config.head_weights], dim, times="times").drop(GROUP)
    raise ValueError(f"unknown pooling {config.pooling!r}")


def train_and_evaluate(
    features: DataFrame, row_id: str, dim: int, sizes: tuple[int, ...],
    share: float = HOLDOUT_SHARE, seed: int = SEED, max_iter: int = 100, written: bool = False,
):
    """Fit on the train side of ``row_id, vector, target``; return the model and the metrics per side.

    ``written`` says that the features are a written table, of which no other copy is needed.
    """
    sides = holdout_split(features if written else durable(features, "features"), row_id, share, seed)
    model = classifier_fit(split_mode(sides, "train"), dim, sizes, max_iter=max_iter, seed=seed)
    scored = classifier_predict(model, sides)
    loop = F.when(F.col("is_val"), "Val").otherwise("Train").alias("loop")
    return model, batch_metrics(scored.select("*", loop), ["loop"])
