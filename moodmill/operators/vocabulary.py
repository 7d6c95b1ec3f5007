"""Vocabulary of a token column, and encoding of token sequences by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moodmill.functions.tokens import exploded
from moodmill.operators.lookup import HOT_SHARE, lookup
from moodmill.operators.ordering import with_ordinal
from moodmill.session import durable

# The padding word and the unknown word of the token dictionary.
PAD_WORD = " "
UNKNOWN = "UNK"
# A summary of ``t`` items is off by at most 3.5 rows in ``t / 0.75``; an item that it does not report may have twice that.
UNSEEN = 2 * 3.5 * 0.75


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Occurrences of each token: ``token, n``."""
    items = df.select(exploded(F.col(tokens)).alias("token")).where(F.col("token").isNotNull())
    return items.groupBy("token").agg(F.count("*").alias("n"))


def frequent_counts(df: DataFrame, tokens: str, top: int, min_count: int, tracked: int) -> DataFrame | None:
    """Exact counts that hold the ``top`` most frequent tokens of at least ``min_count``, or None if that is not proven.

    Each task keeps a summary of ``tracked`` tokens and the summaries are merged, so what is shuffled does
    not grow with the number of distinct tokens. The tokens of the merged summary are counted exactly. A token
    that it lacks occurs at most as often as the bound of the summary says, and at most as often as
    there are rows that belong to no counted token; if the last place is above the smaller of the two,
    no token is missing. Reserved words take no part.
    """
    items = df.select(exploded(F.col(tokens)).alias("token"))
    items = items.where(F.col("token").isNotNull() & ~F.col("token").isin(PAD_WORD, UNKNOWN))
    found = F.expr(f"approx_top_k(token, {tracked}, {tracked})")
    summary = durable(items.agg(F.count("*").alias("rows"), found.alias("found")), "frequent")
    # At most ``tracked`` rows.
    named = summary.select(F.explode("found").alias("f")).select(F.col("f.item").alias("token"))
    met = lookup(items, named, "token", "left_semi")
    counts = durable(met.groupBy("token").agg(F.count("*").alias("n")), "counts")
    rows = summary.first().rows
    uncounted = rows - (counts.agg(F.sum("n").alias("n")).first().n or 0)
    places = counts.where(F.col("n") >= min_count).orderBy(F.desc("n")).limit(top)
    last = places.agg(F.count("*").alias("places"), F.min("n").alias("n")).first()
    needed = last.n if last.places == top and top else min_count
    return counts if min(uncounted, UNSEEN * rows / tracked) < needed else None


def build_vocabulary(
    df: DataFrame, tokens: str = "tokens", min_count: int = 1, size: int | None = None,
    tracked: int | None = None,
) -> DataFrame:
    """``token, idx, n`` by falling frequency, ties by token; the reserved words come first.

    ``size`` bounds the rows including the two reserved words. With ``tracked`` (up to 1,000,000), the tokens
    within ``size`` are found by summaries of that many tokens, if the data let that be proven; all tokens
    are counted otherwise. The rows are the same.
    """
    reserved = [PAD_WORD, UNKNOWN]
    if tracked is not None and size is None:
        raise ValueError("tracked needs a size")
    counts = frequent_counts(df, tokens, max(0, size - len(reserved)), min_count, tracked) if tracked else None
    counts = token_counts(df, tokens) if counts is None else counts
    counts = counts.where((F.col("n") >= min_count) & ~F.col("token").isin(reserved))
    ranked = with_ordinal(counts, [F.desc("n"), F.asc("token")], "idx")
    ranked = ranked.select("token", (F.col("idx") + len(reserved)).alias("idx"), "n")
    first = df.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(reserved)], "token string, idx bigint, n bigint"
    )
    vocabulary = first.unionByName(ranked)
    return vocabulary if size is None else vocabulary.where(F.col("idx") < size)


def sequence_steps(df: DataFrame, tokens: str, name: str = "word") -> DataFrame:
    """One row per item of a sequence: the other columns, ``pos`` and the item."""
    rest = [c for c in df.columns if c != tokens]
    steps = df.select(*rest, exploded(F.col(tokens), with_position=True).alias("pos", name))
    return steps.where(F.col("pos").isNotNull())


def _frequent(vocabulary: DataFrame) -> list:
    """The tokens that hold ``HOT_SHARE`` of all; the reserved words, which are not counted, are among them."""
    total = vocabulary.agg(F.sum("n").alias("n")).first().n or 0
    often = F.col("token").isin(PAD_WORD, UNKNOWN) | (F.col("n") >= max(2, int(total * HOT_SHARE)))
    return [r.token for r in vocabulary.where(often).select("token").collect()]


def encode_ids(
    df: DataFrame, vocabulary: DataFrame, keys: list[str], tokens: str = "tokens", oov: str = "error",
    counted: bool = False,
) -> DataFrame:
    """Replace tokens by their index: ``keys`` and ``ids``, in the order of the tokens.

    ``oov`` says what an unknown token does: ``'error'`` fails the job and names
    it, ``'unk'`` takes the index of the unknown word, ``'drop'`` leaves it out. Two
    rows with the same keys would become one sequence, which fails the job.

    ``counted`` says that ``n`` of the vocabulary counts all tokens of ``df``, so that the frequent ones, which a join with a
    large vocabulary spreads, need no count of their own.
    """
    table = vocabulary.select("token", "idx")
    # A text without tokens keeps one row without position and gets no ids.
    steps = df.select(*keys, exploded(F.col(tokens), with_position=True).alias("pos", "token"))
    found = lookup(steps, table, "token", "left", frequent=(lambda: _frequent(vocabulary)) if counted else None)
    if oov == "error":
        failed = F.raise_error(F.concat(F.lit("unknown token: "), F.col("token"))).cast("bigint")
        idx = F.coalesce(F.col("idx"), F.when(F.col("pos").isNotNull(), failed))
    elif oov == "unk":
        row = table.where(F.col("token") == UNKNOWN).first()
        if row is None:
            raise ValueError(f"the vocabulary has no {UNKNOWN}")
        idx = F.coalesce(F.col("idx"), F.lit(row.idx))
    elif oov == "drop":
        idx = F.col("idx")
    else:
        raise ValueError(f"unknown oov rule {oov!r}")
    item = F.when(F.col("pos").isNotNull() & idx.isNotNull(), F.struct(F.col("pos"), idx.alias("idx")))
    # A group is the tokens of one text.
    encoded = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.count("*").alias("_n"), F.max("pos").alias("_last")
    )
    twice = F.col("_n") > F.coalesce(F.col("_last") + 1, F.lit(1))
    failed = F.raise_error(F.lit(f"keys {', '.join(keys)} are not unique")).cast("array<bigint>")
    return encoded.select(*keys, F.when(twice, failed).otherwise(F.transform("_items", lambda x: x["idx"])).alias("ids"))
