"""Dictionary files, text lines, prepared and training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moodmill.functions.text import strip_whitespace
from moodmill.operators.vocabulary import PAD_WORD, UNKNOWN

# First characters of dictionary lines, and the mark of the label set.
ENTRY_LINE = "^[12]"
LABEL_MARK = " 64"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``_at``, which orders them as they stand in the files."""
    place: Column = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select(F.col("value").alias("line"), place.alias("_at"))


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that is read by fewer tasks than there are cores.

    A few large row groups would leave most cores idle in the text expressions
    that follow. An input with splits for all cores is returned as it is, without
    a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_emoji_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``emoji, description, is_64``, one row per emoji.

    The description is that of its last line; ``is_64`` is true if the description of any
    of its lines ends in the mark. An entry line without a description fails the job.
    """
    tail = F.substring_index(strip_whitespace(F.col("line")), "# ", -1)
    failed = F.raise_error(F.concat(F.lit("emoji dictionary: no description in "), F.col("line")))
    entries = (
        _lines(spark, path)
        .where(F.col("line").rlike(ENTRY_LINE))
        .select(
            F.when(F.contains(tail, F.lit(" ")), F.substring_index(tail, " ", 1)).otherwise(failed).alias("emoji"),
            F.regexp_extract(tail, "(?s)^[^ ]* (.*)$", 1).alias("description"),
            "_at",
        )
        .where(F.col("emoji") != "")
    )
    return entries.groupBy("emoji").agg(
        F.max_by("description", "_at").alias("description"),
        F.bool_or(F.col("description").endswith(LABEL_MARK)).alias("is_64"),
    )


def read_lines(spark: SparkSession, path: str, n: int = -1) -> DataFrame:
    """The lines of text files, the first ``n`` of them if ``n`` is positive."""
    lines = _lines(spark, path)
    return (lines.orderBy("_at").limit(n) if n > 0 else lines).select("line")


def write_prepared(
    df: DataFrame, path: str, max_records: int = 5_000_000, mode: str = "error", parts: int | None = None
) -> None:
    """Write prepared rows as Parquet, one folder per language.

    Adaptive execution gathers a language into few files and splits a frequent one
    over many tasks. Where it is off, as in streaming, each language is spread over
    ``parts``, by default as many as the session has shuffle partitions.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        spread = df.hint("rebalance", "lang")
    else:
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts))
        spread = df.repartition(F.col("lang"), part)
    spread.write.partitionBy("lang").option("maxRecordsPerFile", max_records).mode(mode).parquet(path)


def read_training(
    spark: SparkSession, path: str, language: str, text: str = "processed", target: str = "target"
) -> DataFrame:
    """Text and target of one language."""
    return spark.read.parquet(path).where(F.col("lang") == language).select(text, target)


def check_token_table(table: DataFrame, word_mode: bool = True) -> int:
    """Refuse a token table with doubled indices, uneven vectors or without the needed words.

    Returns the vector size.
    """
    row = table.agg(
        F.count("*").alias("n"), F.countDistinct("idx").alias("ids"), F.countDistinct("token").alias("tokens"),
        F.count_if(F.col("token") == PAD_WORD).alias("pads"), F.count_if(F.col("token") == UNKNOWN).alias("unks"),
        F.min(F.size("vector")).alias("narrow"), F.max(F.size("vector")).alias("wide"),
    ).first()
    if not row.n == row.ids == row.tokens:
        raise ValueError("token table: tokens and indices are not one to one")
    if row.narrow is None or row.narrow < 1 or row.narrow != row.wide:
        raise ValueError("token table: vectors differ in size")
    if word_mode and (row.pads, row.unks) != (1, 1):
        raise ValueError(f"token table: {PAD_WORD!r} and {UNKNOWN!r} are needed")
    return row.wide


def read_token_table(spark: SparkSession, path: str, word_mode: bool = True) -> tuple[DataFrame, int]:
    """A checked token table ``token, idx, vector`` and its vector size."""
    table = spark.read.parquet(path).select("token", "idx", "vector")
    return table, check_token_table(table, word_mode)


def write_token_table(table: DataFrame, name: str, path: str, buckets: int, by: str = "token") -> None:
    """Store a token table in buckets of its token or ``idx``, as the table ``name`` of the catalog with files at ``path``.

    Give at least as many buckets as the session has shuffle partitions: below that Spark may prefer to
    shuffle both sides of a join. A bucket is one file, written by one task, and has about ``1/buckets`` of the table.
    """
    placed = table.select("token", "idx", "vector").repartition(buckets, by)
    placed.write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(name)


def read_bucketed_tokens(spark: SparkSession, name: str, word_mode: bool = True) -> tuple[DataFrame, int]:
    """The checked token table of that name and its vector size; lookups take it with ``bucketed=True``."""
    table = spark.table(name).select("token", "idx", "vector")
    return table, check_token_table(table, word_mode)
