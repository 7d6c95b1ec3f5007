"""Compressed archives of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from moodmill.session import durable

RECORD = "text STRING, _corrupt_record STRING"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the archive with the file they are from: ``source_file, raw``."""
    return named_lines(spark.read.text(path))


def named_lines(lines: DataFrame) -> DataFrame:
    """Name the columns of a batch or streaming text source."""
    return lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))


def parse_records(lines: DataFrame) -> DataFrame:
    """``source_file, raw, text, reason``; blank lines and records without a text are left out.

    ``reason`` is null for a usable record. Only the text is decoded, by a fixed schema.
    """
    record = F.from_json("raw", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # The one-element explode has each line parsed once, however many fields are used.
    parsed = lines.where(F.trim("raw") != "").select("source_file", "raw", F.explode(F.array(record)).alias("_r"))
    text, broken = F.col("_r.text"), F.col("_r._corrupt_record").isNotNull()
    null_text = text.isNull() & F.array_contains(F.json_object_keys("raw"), "text")
    reason = F.when(broken, "invalid_json").when(null_text, "null_text")
    return parsed.select("source_file", "raw", text.alias("text"), reason.alias("reason")).where(
        F.col("text").isNotNull() | F.col("reason").isNotNull()
    )


def split_bad_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records ``(source_file, text)`` and refused ones ``(source_file, raw, reason)``."""
    good = records.where(F.col("reason").isNull()).select("source_file", "text")
    bad = records.where(F.col("reason").isNotNull()).select("source_file", "raw", "reason")
    return good, bad


class TooManyRefused(ValueError):
    """An archive has more refused records than its reader allows."""


def usable_texts(lines: DataFrame, refused: str | None = None, max_refused: float | None = None) -> DataFrame:
    """Texts of the usable records of raw lines, ``source_file, text``.

    Without ``refused`` this is a projection. With it, each record is decoded once and
    routed by one write to a table of two partitions, usable and refused; the refused ones
    go on to that folder, and the result reads the others. The write counts both as it
    goes; a share of refused records above ``max_refused`` raises ``TooManyRefused``, when
    the folder holds them already.
    """
    records = parse_records(lines)
    if refused is None:
        if max_refused is not None:
            raise ValueError("a limit of refused records needs a folder for them")
        return split_bad_records(records)[0]
    counted = Observation()
    broken = F.col("reason").isNotNull()
    routed = records.observe(counted, F.count("*").alias("records"), F.count("reason").alias("refused")).select(
        "source_file", F.when(broken, F.col("raw")).alias("raw"), "text", "reason", broken.alias("_refused")
    )
    written = durable(routed, "records", partition_by="_refused")
    split_bad_records(written.where("_refused"))[1].write.mode("overwrite").parquet(refused)
    n = counted.get
    if max_refused is not None and n["refused"] > max_refused * n["records"]:
        raise TooManyRefused(f"{n['refused']} of {n['records']} records are refused; see {refused}")
    return written.where("NOT _refused").select("source_file", "text")


def read_tweets(
    spark: SparkSession, path: str, refused: str | None = None, max_refused: float | None = None
) -> DataFrame:
    """``source_file, text`` of all records with a text.

    ``refused`` names a folder for the others, a table ``source_file, raw, reason`` that
    a repeated read writes anew; ``max_refused`` is the largest share of them.
    """
    return usable_texts(read_archive(spark, path), refused, max_refused)
