import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill.session import durable
from moodmill.operators import subwords, training_rounds as t
from moodmill.plans.training import FeatureConfig, text_features

MODEL = pathlib.Path("/opt/tokenizers/piece_bpe_32k.model")


def plain_loss(network, vectors, target):
    """Mean cross-entropy, one row, head, layer and unit at a time."""
    parts, total = network.layers(), 0.0
    for row, own in zip(vectors, target):
        logits = []
        for h, state in enumerate(row):
            for i in range(0, len(parts), 2):
                state = [
                    sum(x * w for x, w in zip(state, parts[i][h][:, j])) + parts[i + 1][h][0][j]
                    for j in range(parts[i].shape[2])
                ]
                if i + 2 < len(parts):
                    state = [max(x, 0.0) for x in state]
            logits += state
        total += math.log(sum(math.exp(x) for x in logits)) - logits[own]
    return total


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 3, 240)
    vectors = rng.normal(0, 1, (240, 3, 4))
    vectors[np.arange(240), target, 0] += 2.5
    return vectors, target


def frame(spark, rows):
    data = [([list(map(float, v)) for v in x], int(y), i % 4 == 0) for i, (x, y) in enumerate(zip(*rows))]
    return spark.createDataFrame(data, "vectors array<array<double>>, target int, is_val boolean").repartition(5)


@pytest.mark.parametrize("sizes", [(4, 1), (4, 5, 1), (4, 6, 3, 2)])
def test_gradient_against_differences(rows, sizes):
    vectors, target = rows[0][:6], rows[1][:6]
    network = t.HeadNetwork.random(3, sizes)
    found, loss, _ = network.gradient(vectors.transpose(1, 0, 2), target)
    assert loss.sum() == pytest.approx(plain_loss(network, vectors, target))
    for i in range(0, len(network.weights), 3):
        moved = []
        for step in (1e-5, -1e-5):
            weights = network.weights.copy()
            weights[i] += step
            moved.append(plain_loss(t.HeadNetwork(3, sizes, weights), vectors, target))
        assert found[i] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-4)


def test_sums_of_all_tasks(spark, rows):
    network = t.HeadNetwork.random(3, (4, 5, 1))
    got = t.gradient_sums(frame(spark, rows), network)
    val = np.arange(240) % 4 == 0
    gradient, loss, right = network.gradient(rows[0][~val].transpose(1, 0, 2), rows[1][~val])
    assert np.allclose(got[: len(network.weights)], gradient)
    assert got[len(network.weights) :] == pytest.approx(
        [180, loss.sum(), right.sum(), 60, plain_loss(network, rows[0][val], rows[1][val]), got[-1]]
    )


def test_stop_and_resume_gives_the_same_history(spark, rows, tmp_path):
    data = frame(spark, rows)
    once = t.fit_epochs(data, 3, (4, 5, 1), str(tmp_path / "once"), epochs=4, rounds=4, rate=0.05)
    parts = str(tmp_path / "parts")
    t.fit_epochs(data, 3, (4, 5, 1), parts, epochs=1, rounds=4, rate=0.05)
    (tmp_path / "parts/00001").mkdir()  # an epoch that was not finished
    again = t.fit_epochs(data, 3, (4, 5, 1), parts, epochs=4, rounds=4, rate=0.05)
    a, b = (sorted((r.epoch, r.loop, r.n, round(r.loss, 9), r.top1, r.is_best) for r in h.table().collect()) for h in (once, again))
    assert a == b and len(a) == 8
    assert np.allclose(once.network(3).weights, again.network(3).weights)
    val = {e: loss for e, loop, _, loss, *_ in a if loop == "Val"}
    assert {e for e, *_, best in a if best} == {min(val, key=lambda e: (val[e], e))} == {once.best_epoch()}
    majority = np.bincount(rows[1][::4]).max() / 60 * 100
    assert max(top for _, loop, _, _, top, _ in a if loop == "Val") > majority
    with pytest.raises(ValueError):
        t.fit_epochs(data, 3, (4, 2, 1), parts, epochs=5)


def test_predictions_and_edges(spark, rows, tmp_path):
    network = t.HeadNetwork.random(3, (4, 5, 1))
    data = frame(spark, rows).withColumn("note", F.lit("x"))
    out = t.network_predict(network, data).collect()
    assert out[0].note == "x" and all(r.prediction == int(np.argmax(r.logits)) for r in out)
    for r in out[:5]:
        assert np.allclose(r.logits, network.logits(np.array(r.vectors)[:, None, :])[0])
    odd = spark.createDataFrame(
        [(None, 1, False), ([[1.0] * 4, None, [1.0] * 4], 1, True), ([[1.0] * 4] * 3, None, None)],
        "vectors array<array<double>>, target int, is_val boolean",
    )
    assert sorted(str(r.prediction is None) for r in t.network_predict(network, odd).collect()) == ["False", "True", "True"]
    history = t.fit_epochs(odd, 3, (4, 5, 1), str(tmp_path / "none"), epochs=1, start=network)
    assert [(r.n, r.loss, r.is_best) for r in history.table().collect()] == [(0, None, False)] * 2
    assert np.allclose(history.network(0).weights, network.weights)
    outside = data.withColumn("target", F.lit(3))
    with pytest.raises(Exception, match="not below 3"):
        t.fit_epochs(outside, 3, (4, 5, 1), str(tmp_path / "outside"), epochs=1)


def test_heads_of_a_row(spark):
    rows = [(1, 1, [3.0]), (1, 0, [2.0]), (2, 0, [4.0]), (2, 1, [5.0])]
    found = t.side_by_side(spark.createDataFrame(rows, "k int, head int, vector array<double>"), ["k"], 2)
    assert {r.k: r.vectors for r in found.collect()} == {1: [[2.0], [3.0]], 2: [[4.0], [5.0]]}
    with pytest.raises(Exception, match="heads 0 to 1"):
        t.side_by_side(spark.createDataFrame(rows[:3], "k int, head int, vector array<double>"), ["k"], 2).collect()


@pytest.mark.skipif(not MODEL.exists(), reason="needs a public subword model")
def test_encoded_texts_are_not_encoded_again(spark):
    model = MODEL.read_bytes()
    df = spark.createDataFrame([(1, "some words of a text"), (2, None), (3, "")], "doc_id int, processed string")
    held = durable(df.select("doc_id", subwords.subword_ids(F.col("processed"), model).alias("held")))
    samples = subwords.subword_samples(held, ["doc_id"], model, max_len=3, encoded="held")
    assert "Python" not in samples._jdf.queryExecution().executedPlan().toString()
    assert sorted(samples.collect()) == sorted(subwords.subword_samples(df, ["doc_id"], model, max_len=3).collect())


@pytest.mark.skipif(not MODEL.exists(), reason="needs a public subword model")
def test_subwords(spark):
    import sentencepiece

    model = MODEL.read_bytes()
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {1: "Hello there, naïve  wörld", 2: "", 3: None, 4: "日本語 \n x", 5: "a " * 300, 6: " lead"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, processed string")
    ids = {r.doc_id: r for r in df.select("doc_id", "processed", subwords.subword_ids(F.col("processed"), model).alias("ids")).collect()}
    assert all(ids[k].ids == plain.encode(t or "") for k, t in texts.items())
    back = df.select("doc_id", subwords.subword_text(subwords.subword_ids(F.col("processed"), model), model).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {k: t or "" for k, t in texts.items()}
    for r in subwords.subword_samples(df, ["doc_id"], model, max_len=7).collect():
        want = plain.encode(texts[r.doc_id] or "")
        assert r.seq_len == min(7, len(want)) and r.ids == (want + [0] * 7)[:7]
    size = plain.get_piece_size()
    table = spark.range(size).select(
        F.col("id").cast("string").alias("token"), F.col("id").alias("idx"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector")
    )
    config = FeatureConfig("bpe", "max", 10, subword_model=model)
    found = {r.doc_id: r.vector for r in text_features(df, ["doc_id"], table, 2, config).collect()}
    assert found[1] == [float(max(plain.encode(texts[1])[:10])), 1.0]
