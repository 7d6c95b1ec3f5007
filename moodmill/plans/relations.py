"""Relations derived from the given tables, on which the registered queries run.

The tables hold no tweets, so lines of the documents are dressed as such: the
length of a line decides which mention, link, tag, entity and emoji it gets. The
whole text of every document is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moodmill.functions.text import process_tweets
from moodmill.functions.tokens import exploded, plain_text_split
from moodmill.operators.vocabulary import build_vocabulary
from moodmill.session import durable, scratch_path
from moodmill.sources.tables import spread_small

# The emoji dictionary of the queries and the class of each label.
EMOJIS = (
    ("😂", True),
    ("😍", True),
    ("😭", True),
    ("👍", True),
    ("❤️", True),
    ("❤", False),
    ("🔥", False),
    ("👍🏽", False),
)
LABEL_MAP = (("😂", 0), ("😍", 1), ("😭", 2), ("👍", 3), ("❤️", 4))
ARCHIVE_PARTS = 16
LATE_SOURCE = "src0"
TAILS = ("😂😂", "😍", "😂 😍", "🔥", "👍🏽", "👍 x 👍", "😭", "❤️", "")


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; those with long texts are read by all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def dictionary(spark: SparkSession) -> DataFrame:
    """The emoji dictionary of the queries."""
    return spark.createDataFrame(list(EMOJIS), "emoji string, is_64 boolean")


def label_map(spark: SparkSession) -> DataFrame:
    """The class index of each label emoji."""
    return spark.createDataFrame(list(LABEL_MAP), "emoji string, target int")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: ``doc_id, lang, source, pos, line``."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", exploded(F.split("text", "\n"), with_position=True).alias("pos", "line")
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dressed as tweets: ``doc_id, pos, lang, source_file, text``."""
    size = F.length("line")

    def every(n: int, part: Column | str, other: str = "") -> Column:
        return F.when(size % n == 0, part).otherwise(other)

    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), size % len(TAILS))
    text = F.concat(
        every(5, F.concat(F.lit("RT @u"), F.col("doc_id").cast("string"), F.lit(": "))),
        "line",
        every(4, " http://t.co/x1 #tag"),
        every(6, " a &amp; b", " "),
        tail,
    )
    return document_lines(spark, sf_dir).select(
        "doc_id", "pos", "lang", F.col("source").alias("source_file"), text.alias("text")
    )


def archive(spark: SparkSession, sf_dir: str, late: bool | None = None, path: str | None = None) -> str:
    """The tweets as compressed JSON lines, one folder per source; returns the path.

    Junk in a text decides which records lack the text, hold a null or are cut
    off, and after which a blank line follows. Texts of a source that are equal
    when cleaned share a file, so that duplicates per file are those per source,
    though a source may have several files. ``late`` leaves out one source, or adds only
    that one to the archive at ``path``.
    """
    part = F.pmod(F.xxhash64(process_tweets(F.col("text"))), F.lit(ARCHIVE_PARTS))
    rows = tweets(spark, sf_dir).repartition(F.col("source_file"), part)

    def has(junk: str) -> Column:
        return F.contains("text", F.lit(junk))

    record = (
        F.when(has("$$$"), F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}")))
        .when(has("%%%"), F.lit('{"text": null}'))
        .when(has("&&&"), F.concat(F.lit('{"text": "'), F.col("doc_id").cast("string")))
        .when(has("!!"), F.concat(F.to_json(F.struct("text")), F.lit("\n")))
        .otherwise(F.to_json(F.struct("text")))
    )
    path = path or scratch_path(spark, "archive")
    if late is not None:
        rows = rows.where((F.col("source_file") == LATE_SOURCE) == F.lit(late))
    (
        rows.select(F.col("source_file").alias("source"), record.alias("value"))
        .write.mode("append").partitionBy("source").option("compression", "bzip2").text(path)
    )
    return path


def source_of(path: Column) -> Column:
    """The source folder of an archive file."""
    return F.regexp_extract(path, "source=([^/]+)", 1)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, tokens`` of the documents, lines joined by spaces."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", plain_text_split(text).alias("tokens"))


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, tokens`` of the conversations."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", plain_text_split(text).alias("tokens")
    )


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, idx, vector``: the most frequent words, each with the embedding of its index."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    vocabulary = build_vocabulary(document_words(spark, sf_dir), size=vectors.count())
    return durable(vocabulary.join(vectors, "idx").select("token", "idx", "vector"), "tokens")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as batch metrics: ``run, epoch, loop, batch, value, n``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.dayofyear("ts").alias("epoch"),
        F.when(F.col("event_type").isin("click", "view"), "Train").otherwise("Val").alias("loop"),
        F.col("event_id").alias("batch"),
        "value",
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("n"),
    )
