import bz2
import json
import shutil

import pytest
from pyspark.sql import functions as F

from moodmill.operators.evaluation import running_average
from moodmill.operators.language import language_fit
from moodmill.plans.preparation import labelled_tweets, prepare
from moodmill.plans.relations import dictionary
from moodmill.sources.archive import TooManyRefused, read_tweets
from moodmill.streaming.incremental import prepare_incremental
from moodmill.streaming.running_average import running_average_stream


def write(path, texts):
    with bz2.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(json.dumps({"text": t}) for t in texts))


def test_files_are_prepared_once(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    labelled = spark.createDataFrame(
        [("the cat is on the mat", "en"), ("le chat est sur le tapis", "fr")], "text string, lang string"
    )
    model = language_fit(labelled)
    for i in range(5):
        write(source / f"{i}.json.bz2", ["the same cat is here 😂", "the same cat is here 😂", f"le chat est {i} ans 😍", "cat"])

    def run():
        prepare_incremental(spark, str(source), target, log, dictionary(spark), model, files_per_batch=2)
        return sorted(map(tuple, spark.read.parquet(target).select("text", "lang", "prob", "class", "count").collect()))

    def batch():
        tweets = read_tweets(spark, str(source))
        return sorted(map(tuple, prepare(tweets, dictionary(spark), model).collect()))

    first = run()
    assert first == batch() and len(first) == 10
    assert {r[1] for r in first} == {"en", "fr"}
    assert run() == first
    write(source / "late.json.bz2", ["the late cat is here 😭"])
    second = run()
    assert second == batch() and len(second) == 11


def test_texts_are_prepared_once_over_all_files_and_runs(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    labelled = spark.createDataFrame([("the cat is here", "en"), ("le chat est ici", "fr")], "text string, lang string")
    model = language_fit(labelled)
    for i in range(5):
        write(source / f"{i}.json.bz2", ["the same cat is here 😂", "the same cat is here 😂", f"le chat est {i % 2} ans 😍"])

    def run(checkpoint=log):
        prepare_incremental(spark, str(source), target, checkpoint, dictionary(spark), model, files_per_batch=2, scope="all")
        return sorted(map(tuple, spark.read.parquet(target).select("text", "class", "count").collect()))

    def batch():
        rows = labelled_tweets(read_tweets(spark, str(source)), dictionary(spark), scope="all")
        return sorted(map(tuple, rows.select("text", "class", "count").collect()))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = run()
    assert first == batch() and len(first) == 3
    assert run() == first
    write(source / "late.json.bz2", ["the late cat is here 😭", "the same cat is here 😂"])
    shutil.copytree(log, tmp_path / "old-log")
    second = run()
    assert second == batch() and len(second) == 4
    # The batch is run again from the state before it, as after a failure.
    assert run(str(tmp_path / "old-log")) == second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    with pytest.raises(ValueError, match="scope"):
        prepare_incremental(spark, str(source), target, log, dictionary(spark), model, scope="some")


def test_a_batch_with_too_many_refused_records_stops(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"text": "the cat 😂"}\n{"text": "cut\n')
    model = language_fit(spark.createDataFrame([("the cat", "en")], "text string, lang string"))
    paths = [str(tmp_path / x) for x in ("out", "log", "refused")]

    def run(limit):
        prepare_incremental(spark, str(source), paths[0], paths[1], dictionary(spark), model, refused=paths[2], max_refused=limit)

    with pytest.raises(Exception, match="1 of 2 records are refused") as raised:
        run(0.4)
    assert TooManyRefused.__name__ in str(raised.value)
    run(0.5)
    assert spark.read.parquet(paths[0]).where(F.col("text").contains("cat")).count() == 1


def test_running_means_go_on_from_the_state_before(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("metrics", "averages", "log")]
    schema = "run string, batch long, value double, n long, avg_of string"

    def arrive(rows, log=paths[2]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
        running_average_stream(spark, paths[0], paths[1], log, ["run"])

    def seen(part):
        return sorted(map(tuple, spark.read.parquet(f"{paths[1]}/{part}/*").collect()), key=str)

    first = [("a", 1, 2.0, 1, "x"), ("a", 2, 4.0, 3, "y"), (None, 5, 1.0, 2, None), ("b", 3, None, 2, "z")]
    arrive(first)
    assert {r[0]: r[-1] for r in seen("rows") if r[1] != 1} == {"a": 3.5, None: 1.0, "b": None}
    shutil.copytree(paths[2], tmp_path / "old-log")
    # Batch 2 again and a null one are late; a null group goes on as any other.
    second = [("a", 2, 9.0, 9, "again"), ("a", None, 9.0, 9, "none"), ("a", 4, 8.0, 4, "w"), (None, 6, 4.0, 1, "v"), ("b", 4, 6.0, 1, "u")]
    arrive(second)
    whole = running_average(spark.createDataFrame(first + second[2:], schema), ["run"])
    expected = sorted(map(tuple, whole.collect()), key=str)
    assert seen("rows") == expected and len(expected) == 7
    assert [r[-1] for r in seen("late")] == ["again", "none"]
    # The second micro-batch is run again from the log before it, as after a failure.
    arrive([], str(tmp_path / "old-log"))
    assert seen("rows") == expected and len(seen("late")) == 2
    state = spark.read.parquet(f"{paths[1]}/state/000001")
    assert {r.run: (r._before_sum, r._before_count, r._last) for r in state.collect()} == {
        "a": (46.0, 8, 4), None: (6.0, 3, 6), "b": (6.0, 3, 4)
    }
