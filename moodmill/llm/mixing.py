"""Mixing sources to target weights by systematic sampling.

Targets are in words. A source cannot give more than a fixed multiple of its size; what
it cannot take is shared again among the others by weight. Within a source every
document has the same expected number of copies, target over size. Documents are ordered
by size and key; the prefix sums of the expected copies plus one random offset of the
source cross integers, and a document is emitted once for each integer crossed at it. So
copies differ from the expectation by less than one anywhere in the order, and the words
taken differ from the target by about the largest document.

Only DataFrame functions are used. The prefix sum is the rank within the source times
the expectation. Ranks come from one range sort and the row counts of its partitions, so
a source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moodmill.llm.common import WHITESPACE, durable, ranked

# Fixed values of the query.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 20_240_501


def word_count(text: Column) -> Column:
    """Number of words between whitespace; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITESPACE + "+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, weight, target`` from one row per source ``source, source_size``.

    Weights repeat in the order of the sources by code point, null last. ``share`` times
    the whole size is dealt by weight; a source stops at ``most`` times its size.
    """
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "_at")
    repeated = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_at", F.lit(len(weights))).cast("int"))
    weighed = durable(placed.withColumn("weight", repeated).drop("_at"), "weights")
    total = float(weighed.agg(F.sum("source_size").alias("n")).first().n or 0) * share
    # A source whose limit is below level * weight is capped. Raising the level caps more.
    level = 0.0
    limit = F.col("source_size") * float(most)
    while True:
        capped = limit <= F.col("weight") * level
        row = weighed.agg(
            F.sum(F.when(capped, limit)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        if not row.open:
            break
        raised = (total - (row.full or 0.0)) / row.open
        if raised <= level:
            break
        level = raised
    return weighed.withColumn("target", F.least(limit, F.col("weight") * level))


def sampled(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows that hold ``key, source, size``.

    Rows are ordered by source, size and key; equal rows are interchangeable. The same
    rows and seed give the same copies on every run.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col(key)]
    placed = ranked(docs, order, "_at")
    firsts = placed.groupBy("source").agg(F.min("_at").alias("_first"))
    # A random offset in [0, 1) from 52 bits of a hash of the source.
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00")), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    known = durable(
        targets.join(firsts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "source_size", "target", "_first", offset.alias("_u")),
        "targets",
    ).withColumnRenamed("source", "_of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_at") - F.col("_first")
    crossed = F.floor((rank + 1) * expected + F.col("_u")) - F.floor(rank * expected + F.col("_u"))
    return (
        placed.join(known, F.col("source").eqNullSafe(F.col("_of")), "left")
        .withColumn("copies", crossed.cast("int"))
        .drop("_of", "_at", "_first", "_u")
    )


def mixture(docs: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``key, size, source, source_size, target, copies, taken`` of all documents.

    A text without words has size 0 and takes none; a source without words has target
    0. Null is a source, the last one. An empty table gives an empty one.
    """
    narrow = docs.select(key, "source", word_count(F.col("text")).alias("size"))
    sized = durable(narrow, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes)
    return sampled(sized, targets, key, seed).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with the columns of ``docs``.

    The texts go through the range sort with their ranks, so repeated rows and rows
    without a key are sampled as rows of their own.
    """
    names = docs.columns
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(key).alias("_key"), "source",
        word_count(F.col("text")).alias("size"),
    )
    # The sizes alone fix the targets; texts are read again for the sort.
    sizes = boxed.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes)
    dealt = sampled(boxed, targets, "_key", seed)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return dealt.where(F.col("copies") > 0).select("_row", copies.alias("_copy")).select("_row.*")
