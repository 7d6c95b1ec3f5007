"""Vectors of words and ids from token tables.

A token table has ``token STRING, idx BIGINT, vector ARRAY``. Word vectors are
computed once per distinct word, or once per group of texts that has the word, and joined
back, so frequent words and padding cost nothing extra. ``bucketed`` says that the table is stored in buckets of its
token (of its ``idx`` for ``embedding_lookup``), and then it is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from moodmill.functions.tokens import exploded, word_ngrams
from moodmill.functions.vectors import dot, double_array, grouped_vectors, mean_vector, nonlinear, with_checked
from moodmill.operators.lookup import BROADCAST_BYTES, lookup
from moodmill.operators.vocabulary import UNKNOWN
from moodmill.session import durable

# N-gram lengths of the embedding bag, and the width rule of categories.
MIN_GRAM, MAX_GRAM = 1, 6
MAX_CATEGORY_WIDTH = 50
GROUP_STEPS = 1 << 20  # steps of the texts for which a vector is computed once
PARTS_OF_GROUP = 4  # partitions per group: the hash of a group's number lays few of them into one


def _distinct(words: DataFrame) -> DataFrame:
    return words.select("word").distinct()


def _keys(group: str | None) -> list[str]:
    return ["word"] if group is None else [group, "word"]


def _hits(words: DataFrame, table: DataFrame, bucketed: bool = False, how: str = "inner", group: str | None = None) -> DataFrame:
    """The known n-grams of distinct words, with their position and what the table has for them."""
    grams = words.select(
        *_keys(group), exploded(word_ngrams(F.col("word"), MIN_GRAM, MAX_GRAM), with_position=True).alias("pos", "token")
    )
    return lookup(grams, table, "token", how, bucketed=bucketed)


def _vector_hits(words: DataFrame, table: DataFrame, dim: int, bucketed: bool, group: str | None) -> DataFrame:
    """The vectors of the known n-grams of the distinct words, and a row per word that stays if it has none.

    Words are dealt over all shuffle partitions, since the sums of a word need many times its own space; a
    table that is broadcast leaves its n-grams there, so no vector is shuffled. Words with a ``group`` are
    distinct already and lie by it.
    """
    if group is None:
        words = _distinct(words).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    found = _hits(words, table, bucketed, "left", group)
    return with_checked(found.where(F.col("vector").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0)), dim)


def _unknown(table: DataFrame):
    row = table.where(F.col("token") == UNKNOWN).first()
    if row is None:
        raise ValueError(f"the token table has no {UNKNOWN}")
    return row


def ngram_lookup(words: DataFrame, table: DataFrame, bucketed: bool = False) -> DataFrame:
    """Per distinct ``word``: ``ids`` of its known n-grams, repeats kept, and ``known``.

    A word without any known n-gram gets the id of the unknown word.
    """
    ids = table.select("token", "idx")
    unk = _unknown(ids).idx
    distinct = _distinct(words)
    # A group is the n-grams of one word.
    grouped = _hits(distinct, ids, bucketed).groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_items")
    )
    known = F.col("_items").isNotNull()
    found = F.transform("_items", lambda x: x["idx"])
    return distinct.join(grouped, "word", "left").select(
        "word", F.when(known, found).otherwise(F.array(F.lit(unk))).alias("ids"), known.alias("known")
    )


def unknown_words(words: DataFrame, table: DataFrame, bucketed: bool = False) -> DataFrame:
    """Occurrences of each word without any known n-gram: ``word, n``."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    known = _hits(_distinct(words), table.select("token"), bucketed).select("word")
    return counts.join(known, "word", "left_anti")


def _with_unknown(pooled: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """All words, those without a known n-gram with the vector of the unknown word."""
    fallback = double_array(_unknown(table.select("token", "vector")).vector)
    return pooled.select(*keys, F.coalesce("vector", fallback).alias("vector"))


def word_vectors_mean(
    words: DataFrame, table: DataFrame, dim: int, bucketed: bool = False, group: str | None = None
) -> DataFrame:
    """Per distinct ``word``: the mean ``vector`` of its known n-grams.

    With ``group``, a column of ``words`` by which they are partitioned, distinct together with it: per group and word.
    """
    found = _vector_hits(words, table.select("token", "vector"), dim, bucketed, group)
    pooled = grouped_vectors(found, _keys(group), dim, {"vector": ("vector", mean_vector)})
    return _with_unknown(pooled, table, _keys(group))


def word_vectors_attention(
    words: DataFrame, table: DataFrame, weights: list[float], dim: int, nonlinearity: str = "tanh",
    bucketed: bool = False, group: str | None = None,
) -> DataFrame:
    """Per distinct ``word``: its n-gram vectors summed with softmax weights; ``group`` as for the mean.

    The weighted mean with ``exp(score)`` is the softmax sum. A bounded score
    needs no shift; for ``relu`` the largest score of the word is subtracted.
    """
    scored = table.select(
        "token", "vector", nonlinear(dot(F.col("vector"), weights), nonlinearity).alias("_score")
    )
    found = _vector_hits(words, scored, dim, bucketed, group)
    shift = F.lit(0.0)
    if nonlinearity == "relu":
        # The window holds the n-grams of one distinct word.
        shift = F.max("_score").over(Window.partitionBy(*_keys(group)))
    weighted = found.withColumn("_weight", F.exp(F.col("_score") - shift))
    mean = ("vector", lambda c, size: mean_vector(c, size, F.col("_weight")))
    pooled = grouped_vectors(weighted, _keys(group), dim, {"vector": mean})
    return _with_unknown(pooled, table, _keys(group))


def attach_word_vectors(
    samples: DataFrame, steps_of: Callable[[DataFrame], DataFrame], vectors_of: Callable[[DataFrame, str | None], DataFrame],
    dim: int, group: str | None = None, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The steps of texts with the vectors of their words.

    ``samples`` is a written table with the ``words`` of each text and a hash of its keys, ``group``. ``steps_of`` makes
    of them steps with a ``word``, each within its text, and ``vectors_of`` makes the vectors of the distinct words it is given,
    for each group if the column with its number is named. Vectors that fit a broadcast are computed once.
    Others are computed in each group of texts that has the word, so that no vector is written or shuffled: only
    texts and words are. A group has about ``GROUP_STEPS`` steps where that leaves enough groups for all cores.
    The result lies by groups, so an aggregate by group and text does not shuffle either.
    """
    spark = samples.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = durable(samples.select(exploded(F.col("words")).alias("word")).distinct(), "words")
    if group is None or words.count() * (8 * dim + 64) <= max_bytes:
        dealt = samples if group is None else samples.repartition(partitions, group)
        vectors = durable(vectors_of(words, None), "word-vectors")
        return lookup(steps_of(dealt), vectors, "word", "left", max_bytes=max_bytes)
    n_steps = samples.agg(F.sum(F.size(F.array_distinct("words"))).alias("n")).first().n or 0
    parts = min(partitions, max(spark.sparkContext.defaultParallelism, -(-n_steps // GROUP_STEPS)))
    grouped = samples.withColumn(group, F.pmod(F.col(group), F.lit(parts)).cast("int"))
    own = grouped.select(group, exploded(F.col("words")).alias("word")).distinct()
    steps, own = (x.repartition(PARTS_OF_GROUP * parts, group) for x in (grouped, own))
    # Both sides lie by the same hash of the group, so the union and the window leave them there.
    sent = vectors_of(own, group).withColumn("_step", F.lit(False))
    met = steps_of(steps).withColumn("_step", F.lit(True)).unionByName(sent, allowMissingColumns=True)
    before = Window.partitionBy(group, "word").orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumn("vector", F.first("vector").over(before)).where("_step").drop("_step")


def embedding_lookup(steps: DataFrame, table: DataFrame, bucketed: bool = False) -> DataFrame:
    """Add the ``vector`` of each step's ``idx``; an id outside the table fails the job."""
    found = lookup(steps, table.select("idx", "vector"), "idx", "left", bucketed=bucketed)
    missing = F.raise_error(F.concat(F.lit("no vector for id "), F.col("idx").cast("string")))
    return found.withColumn("vector", F.coalesce("vector", missing.cast(found.schema["vector"].dataType)))


def category_width(size: int) -> int:
    """Width of the vectors of a category with ``size`` values."""
    return min((size + 2) // 3, MAX_CATEGORY_WIDTH)


def check_category_table(table: DataFrame, size: int) -> None:
    """Refuse a category table with other codes than ``0..size-1`` or another vector width."""
    row = table.agg(
        F.count("*").alias("n"), F.countDistinct("code").alias("codes"),
        F.min("code").alias("low"), F.max("code").alias("high"),
        F.min(F.size("vector")).alias("narrow"), F.max(F.size("vector")).alias("wide"),
    ).first()
    if (row.n, row.codes, row.low, row.high) != (size, size, 0, size - 1):
        raise ValueError(f"category table does not hold the codes 0 to {size - 1} once each")
    if (row.narrow, row.wide) != (category_width(size), category_width(size)):
        raise ValueError(f"category vectors are not {category_width(size)} wide")


def category_embedding(steps: DataFrame, tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Append the vectors of categorical step features to ``vector``.

    ``tables`` maps a code column of ``steps`` to its table ``(code, vector)`` and
    the number of values of the category. Vectors are appended in that order.
    """
    out, parts = steps, [F.col("vector")]
    for i, (column, (table, size)) in enumerate(tables.items()):
        check_category_table(table, size)
        renamed = table.select(F.col("code").alias(column), F.col("vector").alias(f"_category_{i}"))
        out = lookup(out, renamed, column, "left")
        missing = F.raise_error(F.concat(F.lit(f"no vector for {column} "), F.col(column).cast("string")))
        parts.append(F.coalesce(F.col(f"_category_{i}"), missing.cast("array<double>")))
    keep = [c for c in steps.columns if c != "vector"]
    return out.select(*keep, F.concat(*[p.cast("array<double>") for p in parts]).alias("vector"))
