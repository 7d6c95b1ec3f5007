import bz2
import json

import pytest
from pyspark.sql import functions as F

from moodmill.sources import archive, tables


@pytest.fixture
def archive_dir(tmp_path):
    first = [
        json.dumps({"text": "same text", "id": 1}), json.dumps({"id": 2}), json.dumps({"text": None}),
        '{"text": "cut', "", "   ", json.dumps({"text": "line\nbreak é 😂"}), json.dumps({"delete": {"text": "deep"}}),
    ]
    second = [json.dumps({"text": "same text"}), json.dumps({"text": ""})]
    for name, lines in (("a", first), ("b", second)):
        with bz2.open(tmp_path / f"{name}.json.bz2", "wt", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return str(tmp_path)


def test_read_tweets(spark, archive_dir):
    rows = archive.read_tweets(spark, f"{archive_dir}/*.json.bz2").collect()
    assert sorted((r.source_file.rsplit("/", 1)[1], r.text) for r in rows) == [
        ("a.json.bz2", "line\nbreak é 😂"), ("a.json.bz2", "same text"), ("b.json.bz2", ""), ("b.json.bz2", "same text"),
    ]


def test_bad_records(spark, archive_dir):
    good, bad = archive.split_bad_records(archive.parse_records(archive.read_archive(spark, archive_dir)))
    assert good.count() == 4
    assert {(r.raw, r.reason) for r in bad.collect()} == {('{"text": null}', "null_text"), ('{"text": "cut', "invalid_json")}


def test_refused_records_are_written(spark, archive_dir, tmp_path):
    folder = str(tmp_path / "refused")
    for _ in range(2):
        assert archive.read_tweets(spark, f"{archive_dir}/*.json.bz2", folder).count() == 4
    assert spark.read.parquet(folder).count() == 2


def test_records_are_decoded_once(spark, archive_dir, tmp_path):
    read = archive.read_tweets(spark, f"{archive_dir}/*.json.bz2", str(tmp_path / "refused"))
    # The result reads the routed table, not the archive.
    assert read.inputFiles() and not any("json.bz2" in f for f in read.inputFiles())
    lazily = archive.read_tweets(spark, f"{archive_dir}/*.json.bz2")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, lazily.collect()))


def test_too_many_refused_records(spark, archive_dir, tmp_path):
    path, folder = f"{archive_dir}/*.json.bz2", str(tmp_path / "refused")
    assert archive.read_tweets(spark, path, folder, max_refused=2 / 6).count() == 4
    with pytest.raises(archive.TooManyRefused, match="2 of 6"):
        archive.read_tweets(spark, path, folder, max_refused=0.3)
    assert spark.read.parquet(folder).count() == 2
    with pytest.raises(ValueError, match="folder"):
        archive.read_tweets(spark, path, max_refused=0.3)


def test_an_archive_without_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n\n")
    refused = str(tmp_path / "refused")
    assert archive.read_tweets(spark, str(tmp_path / "in"), refused, max_refused=0.0).count() == 0
    assert spark.read.parquet(refused).count() == 0


def test_emoji_dictionary(spark, tmp_path):
    lines = [
        "# comment 1F600", "", "1F602 ; fully-qualified # 😂 face with tears 64", "0023 ; x # # hash",
        "1F600 ; x # 😀 grin 64", "1F600 ; x # 😀 grinning",
        "1F525 ; fully-qualified # 🔥 fire", "2764 FE0F ; x # ❤️ heart", "  1F600 ; x # 😀 indented",
        "2764 FE0F ; x # ❤️ red heart 64  ", "1F44D ; x # 👍 up 64 not",
    ]
    path = tmp_path / "emoji.txt"
    path.write_text("\n".join(lines), encoding="utf-8")
    rows = tables.read_emoji_dictionary(spark, str(path)).collect()
    assert {(r.emoji, r.description, r.is_64) for r in rows} == {
        ("😂", "face with tears 64", True), ("🔥", "fire", False), ("❤️", "red heart 64", True), ("👍", "up 64 not", False),
        ("😀", "grinning", True),
    }
    path.write_text("1F923 ; no description # 🤣", encoding="utf-8")
    with pytest.raises(Exception, match="no description"):
        tables.read_emoji_dictionary(spark, str(path)).collect()


def test_read_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("\n".join(f"line {i}" for i in range(1000)), encoding="utf-8")
    assert [r.line for r in tables.read_lines(spark, str(path), 3).collect()] == ["line 0", "line 1", "line 2"]
    assert tables.read_lines(spark, str(path)).count() == 1000
    assert tables.read_lines(spark, str(path), 0).count() == 1000


def test_prepared_and_training_round_trip(spark, tmp_path):
    rows = spark.range(1000).select(
        F.concat(F.lit("t"), "id").alias("processed"), (F.col("id") % 3).cast("int").alias("target"),
        F.when(F.col("id") % 10 == 0, "fr").otherwise("en").alias("lang"),
    )
    path = str(tmp_path / "prepared")
    tables.write_prepared(rows, path, max_records=100)
    back = tables.read_training(spark, path, "fr")
    assert back.columns == ["processed", "target"] and back.count() == 100
    assert "PartitionFilters: [isnotnull(lang" in back._jdf.queryExecution().executedPlan().toString()
    counts = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert counts.agg(F.max("count")).first()[0] <= 100


def token_rows(**change):
    rows = [(" ", 0, [0.0, 0.0]), ("UNK", 1, [1.0, 1.0]), ("a", 2, [2.0, 2.0])]
    return [change.get(t, (t, i, v)) for t, i, v in rows]


def test_token_table(spark, tmp_path):
    ddl = "token string, idx bigint, vector array<double>"
    path = str(tmp_path / "tokens")
    spark.createDataFrame(token_rows(), ddl).write.parquet(path)
    table, dim = tables.read_token_table(spark, path)
    assert (table.count(), dim) == (3, 2)
    for bad in (
        token_rows(a=("a", 1, [2.0, 2.0])), token_rows(a=("UNK", 2, [2.0, 2.0])),
        token_rows(a=("a", 2, [2.0])), token_rows(UNK=("u", 1, [1.0, 1.0])),
    ):
        with pytest.raises(ValueError):
            tables.check_token_table(spark.createDataFrame(bad, ddl))
    assert tables.check_token_table(spark.createDataFrame(token_rows(UNK=("u", 1, [1.0, 1.0])), ddl), word_mode=False) == 2


def test_small_inputs_are_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert tables.spread_small(spark.read.parquet(path)).rdd.getNumPartitions() == 8
    many = spark.range(100, numPartitions=20)
    assert tables.spread_small(many) is many
