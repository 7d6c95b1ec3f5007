import math

import pytest
from pyspark.sql import functions as F

from moodmill.operators import classifier, dedup, evaluation, splits
from moodmill.operators.language import language_fit, language_predict, language_profiles
from moodmill.plans.relations import label_map
from moodmill.plans.training import train_and_evaluate

LABELLED = [
    ("the cat is on the mat", "en"), ("it is quite well fed", "en"), ("this is the other one", "en"),
    ("le chat est sur le tapis", "fr"), ("il est bien nourri", "fr"), ("voici une autre phrase", "fr"),
]


def test_language(spark):
    labelled = spark.createDataFrame(LABELLED, "text string, lang string")
    model = language_fit(labelled)
    assert model.languages == ("en", "fr")
    asked = spark.createDataFrame([(1, "the mat"), (2, "une phrase est"), (3, ""), (4, "☃"), (5, None)], "id int, text string")
    rows = language_predict(asked, model).orderBy("id").collect()
    assert [r.lang for r in rows] == ["en", "fr", "none", "none", "none"]
    assert [r.prob for r in rows[2:]] == [0.0] * 3 and all(0.5 < r.prob <= 1 for r in rows[:2])
    assert language_predict(asked.unionByName(asked), model).count() == 10


def test_language_equals_a_loop(spark):
    labelled = [("abab", "x"), ("abc", "x"), ("bcbc", "y"), ("cab", None), (None, "y"), ("z", "w")]
    model = language_fit(spark.createDataFrame(labelled, "text string, lang string"), sizes=(1, 2))

    def grams(t):
        return [t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)]

    counts, texts = {}, {}
    for t, lang in labelled:
        if t is not None and lang is not None:
            texts[lang] = texts.get(lang, 0) + 1
            for g in grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    vocabulary = {g for c in counts.values() for g in c}
    asked = ["ab", "cb", "zz", "qab", "q", "abcabc"]
    got = {r.t: (r.lang, r.prob) for r in language_predict(spark.createDataFrame([(t,) for t in asked], "t string"), model, "t").collect()}
    for t in asked:
        known = [g for g in grams(t) if g in vocabulary]
        if not known:
            assert got[t] == ("none", 0.0)
            continue
        scores = {
            lang: math.log((n + 1) / (sum(texts.values()) + len(texts)))
            + sum(math.log((counts[lang].get(g, 0) + 1) / (sum(counts[lang].values()) + len(vocabulary))) for g in known)
            for lang, n in texts.items()
        }
        best = max(sorted(scores), key=scores.get)
        assert got[t][0] == best
        assert got[t][1] == pytest.approx(math.exp(scores[best]) / sum(map(math.exp, scores.values())))


def test_profiles_are_the_most_frequent_grams(spark):
    labelled = spark.createDataFrame([("aab", "x"), ("abc", "x"), ("zz", "y")], "text string, lang string")
    rows = language_profiles(labelled, sizes=(1, 2), top=3).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in rows] == [
        ("x", "a", 3, 1), ("x", "ab", 2, 2), ("x", "b", 2, 3), ("y", "z", 2, 1), ("y", "zz", 1, 2),
    ]


def test_training_frame(spark):
    prepared = spark.createDataFrame(
        [("So GOOD, yes", "en", "😂"), ("other", "en", "🔥")], "text string, lang string, class string"
    )
    with pytest.raises(ValueError, match="source_file"):
        splits.assemble_training(prepared, label_map(spark))
    rows = splits.assemble_training(prepared, label_map(spark), ("text",)).collect()
    assert [tuple(r)[1:] for r in rows] == [("so good yes", 0, "en")]
    named = prepared.withColumn("source_file", F.lit("f"))
    # One text in two files is two rows; a null, an empty name and a separator in it are told apart.
    files = [("f", "a"), ("g", "a"), (None, "a"), ("", "a"), ("f|1:a", "b"), ("f", "1:a|1:b")]
    several = spark.createDataFrame([(s, t, "en", "😂") for s, t in files], "source_file string, text string, lang string, class string")
    assert splits.assemble_training(several, label_map(spark)).select("row_id").distinct().count() == len(files)
    ids = {r.row_id for r in splits.assemble_training(named.unionByName(named), label_map(spark)).collect()}
    assert len(ids) == 1 and ids != {rows[0].row_id}


def test_dedup_scopes_and_union(spark):
    df = spark.createDataFrame([("f1", "a"), ("f1", "a"), ("f2", "a")], "source_file string, text string")
    assert sorted(map(tuple, dedup.dedup(df).collect())) == [("f1", "a"), ("f2", "a")]
    assert [tuple(r) for r in dedup.dedup(df, "all").collect()] == [("a",)]
    tagged = df.withColumn("id", F.monotonically_increasing_id())
    assert dedup.dedup(tagged).count() == 2 and dedup.dedup(tagged).columns == ["source_file", "text", "id"]
    assert dedup.combine_batches([df, df.select("text", "source_file")]).count() == 6
    with pytest.raises(ValueError):
        dedup.dedup(df, "none")


LOGITS = [([2.0, 1.0, 0.0, -1.0], 0), ([1.0, 1.0, 1.0, 0.0], 1), ([1000.0, 0.0, 3.0, 2.0], 3), ([0.0, 0.0, 0.0, 0.0], 3)]


def test_loss_and_accuracy(spark):
    df = spark.createDataFrame(LOGITS, "logits array<double>, target int")
    loss = [math.log(sum(math.exp(x - max(z)) for x in z)) + max(z) - z[t] for z, t in LOGITS]
    row = evaluation.cross_entropy(df).first()
    assert row.loss == pytest.approx(sum(loss) / 4) and row.n == 4
    assert tuple(evaluation.topk_accuracy(df, (1, 2, 3, 4)).first()) == (25.0, 50.0, 75.0, 100.0)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|out of bounds"):
        evaluation.cross_entropy(df.withColumn("target", F.lit(4))).collect()
    both = evaluation.batch_metrics(df.withColumn("b", F.lit(1)), ["b"]).first()
    assert (both.top1, both.top3, both.n) == (25.0, 75.0, 4) and both.loss == pytest.approx(row.loss)


def test_averages(spark):
    rows = [("Train", 0, 4.0, 10), ("Train", 1, 2.0, 30), ("Val", 0, 5.0, 1)]
    df = spark.createDataFrame(rows, "loop string, batch bigint, value double, n bigint")
    got = {r["loop"]: (r["last"], r["sum"], r["count"], r["avg"]) for r in evaluation.weighted_average(df, ["loop"]).collect()}
    assert got == {"Train": (2.0, 100.0, 40, 2.5), "Val": (5.0, 5.0, 1, 5.0)}
    running = evaluation.running_average(df, ["loop"]).orderBy("loop", "batch").collect()
    assert [r.avg for r in running] == [4.0, 2.5, 5.0]
    summary = evaluation.epoch_summary(df.withColumn("epoch", F.lit(1)), ["epoch"], ("value",)).first()
    assert (summary.train_value, summary.val_value) == (2.5, 5.0)


def test_best_epochs(spark):
    history = [100001.0, 5.0, 5.0, 7.0, 4.0]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(history)], "run string, epoch bigint, val_loss double")
    rows = evaluation.best_epochs(df, ["run"]).orderBy("epoch").collect()
    assert [r.is_best for r in rows] == [False, True, False, False, True]
    assert [r.best_score for r in rows] == [100000.0, 5.0, 5.0, 5.0, 4.0]


@pytest.fixture(scope="module")
def points(spark):
    angle = (F.col("id") % 3) * 2.1 + (F.hash("id") % 100) / 400
    return spark.range(300).select(
        "id", F.array(F.cos(angle), F.sin(angle)).alias("vector"), (F.col("id") % 3).cast("int").alias("target")
    )


def test_classifier_beats_the_majority(points):
    model, metrics = train_and_evaluate(points, "id", 2, (8, 3), max_iter=60)
    rows = {r["loop"]: r for r in metrics.collect()}
    assert (rows["Train"].n, rows["Val"].n) == (225, 75)
    assert rows["Val"].top1 > 90 and rows["Val"].top3 == 100.0
    scored = classifier.classifier_predict(model, points)
    assert scored.columns == ["id", "vector", "target", "logits", "prediction"]
    assert scored.select(F.size("logits")).first()[0] == 3


def test_classifier_of_given_weights(spark, points):
    model = classifier.classifier_of_weights(spark, (2, 3), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 0.1, 0.2, 0.3])
    row = classifier.classifier_predict(model, points.limit(1)).first()
    x, y = row.vector
    assert row.logits == pytest.approx([x + 4 * y + 0.1, 2 * x + 5 * y + 0.2, 3 * x + 6 * y + 0.3])


def test_multi_head_classifier(points):
    heads = points.select("id", "target", "vector", F.explode(F.array(*[F.lit(h) for h in range(3)])).alias("head"))
    model = classifier.classifier_fit_multi_head(heads, 3)
    out = classifier.classifier_predict_multi_head(model, heads, ["id", "target"])
    assert out.count() == 300
    assert out.where("prediction = target").count() > 270
