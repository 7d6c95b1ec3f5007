import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill.functions import vectors
from moodmill.functions.vectors import dot, log_sum_exp
from moodmill.operators import embeddings, lookup as lookups, pooling, vocabulary
from moodmill.plans.training import FeatureConfig, encode_samples, text_features, word_samples

DIM = 4
SENTENCES = ["The cat is on the mat", "And it is quite well fed"]
TABLE = "token string, idx bigint, vector array<float>"


def vector(seed):
    return [float(x) for x in np.random.default_rng(seed).normal(size=DIM).astype("float32")]


TOKENS = [" ", "UNK", "<", "at", "<ca", "cat", "is", "e"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(t, i, vector(i)) for i, t in enumerate(TOKENS)], TABLE)


def grams(word):
    marked = f"<{word}>"
    found = [marked[i : i + n] for n in range(1, 7) for i in range(len(marked) - n + 1)]
    return found + ([word] if len(word) < 3 else [])


def ids(word, tokens=TOKENS):
    return [tokens.index(g) for g in grams(word) if g in tokens] or [1]


def softmax_sum(vectors, scores):
    w = np.exp(np.array(scores) - max(scores))
    return (w[:, None] * np.array(vectors)).sum(0) / w.sum()


def test_arithmetic(spark):
    df = spark.createDataFrame([([1.0, 2.0, 800.0],)], "v array<double>")
    row = df.select(dot(F.col("v"), [1.0, -1.0, 0.5]), log_sum_exp(F.col("v"))).first()
    assert row[0] == 399.0 and row[1] == pytest.approx(800.0)


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_ngram_lookup_and_unknown_words(spark, table):
    words = ["cat", "is", "mat", "", " ", "cat", "on"]
    rows = {r.word: r for r in embeddings.ngram_lookup(words_of(spark, words), table).collect()}
    assert len(rows) == 6
    assert all(rows[w].ids == ids(w) and rows[w].known for w in rows)
    bare = table.where("token != '<'")
    tokens = [t if t != "<" else None for t in TOKENS]
    rows = {r.word: r for r in embeddings.ngram_lookup(words_of(spark, words), bare).collect()}
    assert rows["on"].ids == [1] and not rows["on"].known
    assert all(rows[w].ids == ids(w, tokens) for w in rows)
    unknown = embeddings.unknown_words(words_of(spark, words + ["on", "ox"]), bare).collect()
    assert {(r.word, r.n) for r in unknown} == {("on", 2), ("ox", 1), ("", 1)}


@pytest.mark.parametrize("kind", ["tanh", "relu"])
def test_word_vectors(spark, table, kind):
    words, w = ["cat", "is", "mat", "xyz", " "], [400.0, -300.0, 0.1, 0.2] if kind == "relu" else [0.3, -0.2, 0.1, 0.5]
    mean = {r.word: r.vector for r in embeddings.word_vectors_mean(words_of(spark, words), table, DIM).collect()}
    attended = {
        r.word: r.vector
        for r in embeddings.word_vectors_attention(words_of(spark, words), table, w, DIM, kind).collect()
    }
    for word in words:
        vectors = [vector(i) for i in ids(word)]
        assert mean[word] == pytest.approx(np.mean(vectors, axis=0))
        scores = [float(np.dot(v, w)) for v in vectors]
        scores = [math.tanh(s) if kind == "tanh" else max(s, 0.0) for s in scores]
        assert attended[word] == pytest.approx(softmax_sum(vectors, scores))


def test_embedding_lookup_refuses_foreign_ids(spark, table):
    steps = spark.createDataFrame([(1, 0, 5), (1, 1, 0)], "doc int, pos int, idx bigint")
    rows = embeddings.embedding_lookup(steps, table).orderBy("pos").collect()
    assert [r.vector for r in rows] == [vector(5), vector(0)]
    with pytest.raises(Exception, match="no vector for id 99"):
        embeddings.embedding_lookup(steps.withColumn("idx", F.lit(99)), table).collect()


def test_category_embedding(spark):
    assert [embeddings.category_width(n) for n in (1, 5, 7, 148, 1000)] == [1, 2, 3, 50, 50]
    category = spark.createDataFrame([(c, [float(c), -float(c)]) for c in range(5)], "code int, vector array<double>")
    steps = spark.createDataFrame([(0, 0, [9.0], 4), (0, 1, [8.0], 0)], "doc int, pos int, vector array<double>, c int")
    out = embeddings.category_embedding(steps, {"c": (category, 5)}).orderBy("pos").collect()
    assert [r.vector for r in out] == [[9.0, 4.0, -4.0], [8.0, 0.0, -0.0]]
    with pytest.raises(ValueError, match="codes 0 to 5"):
        embeddings.category_embedding(steps, {"c": (category, 6)})
    wide = category.withColumn("vector", F.array(F.lit(0.0)))
    with pytest.raises(ValueError, match="2 wide"):
        embeddings.category_embedding(steps, {"c": (wide, 5)})
    with pytest.raises(Exception, match="no vector for c 7"):
        embeddings.category_embedding(steps.withColumn("c", F.lit(7)), {"c": (category, 5)}).collect()


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(1)
    rows = [(d, p, 1 + d % 6, [rng.gauss(0, 2) for _ in range(DIM)]) for d in range(9) for p in range(6)]
    return rows, spark.createDataFrame(rows, "doc int, pos int, seq_len int, vector array<double>")


@pytest.fixture(params=["per dimension", "whole vectors"])
def way(request, monkeypatch):
    if request.param == "whole vectors":
        monkeypatch.setattr(vectors, "MAX_AGGREGATES", 1)


def groups(rows, kept):
    for doc in range(9):
        yield doc, [r[3] for r in rows if r[0] == doc and (not kept or r[1] < r[2])]


@pytest.mark.parametrize("padding", [True, False])
def test_mean_and_max(sequences, way, padding):
    rows, df = sequences
    mean = {r.doc: r.vector for r in pooling.pool_mean(df, ["doc"], DIM, padding).collect()}
    top = {r.doc: r.vector for r in pooling.pool_max(df, ["doc"], DIM, padding).collect()}
    for doc, vectors in groups(rows, not padding):
        assert mean[doc] == pytest.approx(np.mean(vectors, axis=0))
        assert top[doc] == pytest.approx(np.max(vectors, axis=0))


def test_odd_vectors_have_one_outcome(spark, way):
    ddl = "k string, pos int, seq_len int, vector array<double>"
    rows = [("a", 0, 2, [1.0, 2.0]), ("a", 1, 2, None), ("a", 2, 2, [9.0, 9.0]), ("b", 0, 1, None), ("c", 0, 0, [5.0, -5.0]),
            (None, 0, 1, [-3.0, -4.0])]
    df = spark.createDataFrame(rows, ddl)
    mean = {r.k: r.vector for r in pooling.pool_mean(df, ["k"], 2, False).collect()}
    assert mean == {"a": [1.0, 2.0], "b": None, "c": None, None: [-3.0, -4.0]}
    assert {r.k: r.vector for r in pooling.pool_max(df, ["k"], 2, False).collect()} == mean
    assert {r.k: r.vector for r in pooling.pool_mean(df, ["k"], 2).collect()}["a"] == [5.0, 5.5]
    for kind in ("tanh", "relu"):
        assert {r.k: r.vector for r in pooling.pool_attention(df, ["k"], [1.0, 1.0], 2, kind).collect()} == mean
    for bad in ([1.0], [1.0, None], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="not a vector of 2 numbers"):
            pooling.pool_mean(spark.createDataFrame([("a", 0, 1, bad)], ddl), ["k"], 2).collect()


@pytest.mark.parametrize("kind, scale", [("tanh", 1.0), ("relu", 1.0), ("relu", 1000.0)])
def test_attention(sequences, way, kind, scale):
    rows, df = sequences
    heads = [[0.5] * DIM, [scale, 0.0, 0.0, 0.0]]
    got = {(r.doc, r.head): r.vector for r in pooling.pool_attention_multi(df, ["doc"], heads, DIM, kind).collect()}
    one = {r.doc: r.vector for r in pooling.pool_attention(df, ["doc"], heads[1], DIM, kind).collect()}
    for doc, vectors in groups(rows, True):
        for h, w in enumerate(heads):
            scores = [float(np.dot(v, w)) for v in vectors]
            scores = [math.tanh(s) if kind == "tanh" else max(s, 0.0) for s in scores]
            assert got[doc, h] == pytest.approx(softmax_sum(vectors, scores))
        assert one[doc] == pytest.approx(got[doc, 1])


def test_wide_vectors_are_not_sorted(spark):
    """Beyond one aggregation the steps still meet sums of numbers in a hash aggregate, slice by slice."""
    rng = np.random.default_rng(3)
    rows = [(d, p, 3, [float(x) for x in rng.normal(size=600)]) for d in range(300) for p in range(4)]
    df = spark.createDataFrame(rows, "doc int, pos int, seq_len int, vector array<double>")
    pooled = pooling.pool_attention(df, ["doc"], [0.01] * 600, 600)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan[plan.rindex("Exchange") :] and "partial_sum" in plan[plan.rindex("Exchange") :]
    mean = {r.doc: r.vector for r in pooling.pool_mean(df, ["doc"], 600).collect()}
    got = {r.doc: r.vector for r in pooled.collect()}
    for doc in range(300):
        own = [r[3] for r in rows if r[0] == doc]
        assert mean[doc] == pytest.approx(np.mean(own, axis=0)) and len(got[doc]) == 600
        assert got[doc] == pytest.approx(softmax_sum(own[:3], [math.tanh(0.01 * sum(v)) for v in own[:3]]))


def test_unbounded_scores_need_no_join(sequences):
    """Steps of one sequence over many spans of the scores; only pooled rows are shuffled, and none meets a maximum by a join."""
    rows, df = sequences
    pooled = pooling.pool_attention(df, ["doc"], [400.0, -300.0, 100.0, 7.0], DIM, "relu")
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_sum" in plan[plan.rindex("Exchange") :]
    got = {r.doc: r.vector for r in pooled.collect()}
    for doc, vectors in groups(rows, True):
        scores = [max(float(np.dot(v, [400.0, -300.0, 100.0, 7.0])), 0.0) for v in vectors]
        assert got[doc] == pytest.approx(softmax_sum(vectors, scores))


def test_heads_share_one_shuffle(sequences):
    plan = pooling.pool_attention_multi(sequences[1], ["doc"], [[0.1] * DIM] * 3, DIM)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_vocabulary(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["c", "a", " ", "UNK"],), ([],)], "tokens array<string>")
    rows = vocabulary.build_vocabulary(df).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(" ", 0, 0), ("UNK", 1, 0), ("a", 2, 2), ("b", 3, 2), ("c", 4, 1)]
    assert [r.token for r in vocabulary.build_vocabulary(df, min_count=2, size=3).orderBy("idx").collect()] == [" ", "UNK", "a"]


def test_encoding(spark):
    df = spark.createDataFrame([(1, ["a", "x", "b"]), (2, ["b", "b"]), (3, [])], "id int, tokens array<string>")
    vocab = spark.createDataFrame([("UNK", 1), ("a", 2), ("b", 3)], "token string, idx bigint")
    unk = {r.id: r.ids for r in vocabulary.encode_ids(df, vocab, ["id"], oov="unk").collect()}
    assert unk == {1: [2, 1, 3], 2: [3, 3], 3: []}
    drop = {r.id: r.ids for r in vocabulary.encode_ids(df, vocab, ["id"], oov="drop").collect()}
    assert drop == {1: [2, 3], 2: [3, 3], 3: []}
    with pytest.raises(Exception, match="unknown token: x"):
        vocabulary.encode_ids(df, vocab, ["id"]).collect()
    with pytest.raises(Exception, match="not unique"):
        vocabulary.encode_ids(df.withColumn("id", F.lit(1)), vocab, ["id"], oov="unk").collect()
    known = df.where("id > 1")
    assert {r.id: r.ids for r in vocabulary.encode_ids(known, vocab, ["id"]).collect()} == {2: [3, 3], 3: []}


def test_samples(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b a b a")], "id int, processed string")
    words = {r.id: (r.words, r.seq_len) for r in word_samples(df, ["id"], max_len=4).collect()}
    assert words == {1: (["a", "", "b", " "], 3), 2: (["a", "b", "a", "b"], 4)}
    vocab = spark.createDataFrame([("UNK", 1), ("a", 2), ("b", 3)], "token string, idx bigint")
    ids_ = {r.id: (r.ids, r.seq_len) for r in encode_samples(df, ["id"], vocab, max_len=4, oov="unk").collect()}
    assert ids_ == {1: ([2, 1, 3, 0], 3), 2: ([2, 3, 2, 3], 4)}


@pytest.mark.parametrize("embedding, pooled", [("bag", "mean"), ("bag", "max"), ("wbag", "attention"), ("dict", "attention")])
def test_text_features_on_the_smoke_sentences(spark, table, embedding, pooled):
    w = [0.5] * DIM
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, processed string")
    config = FeatureConfig(embedding, pooled, 8, tuple(w), tuple(w))
    got = {r.id: r.vector for r in text_features(df, ["id"], table, DIM, config, oov="unk").collect()}

    def word_vector(word):
        if embedding == "dict":
            return vector(TOKENS.index(word) if word in TOKENS else 1)
        vectors = [vector(i) for i in ids(word)]
        if embedding == "bag":
            return np.mean(vectors, axis=0)
        return softmax_sum(vectors, [math.tanh(np.dot(v, w)) for v in vectors])

    for i, sentence in enumerate(SENTENCES):
        steps = [word_vector(x) for x in sentence.split(" ")]
        if pooled == "attention":
            expected = softmax_sum(steps, [math.tanh(np.dot(v, w)) for v in steps])
        else:
            padded = steps + [word_vector(" ")] * 2
            expected = np.mean(padded, axis=0) if pooled == "mean" else np.max(padded, axis=0)
        assert got[i] == pytest.approx(expected)


def test_features_of_texts_without_words(spark, table):
    df = spark.createDataFrame([(1, "cat cat is"), (2, None), (None, "is")], "id int, processed string")
    config = FeatureConfig("bag", "attention", 8, (), tuple([0.5] * DIM))
    got = {r.id: r.vector for r in text_features(df, ["id"], table, DIM, config).collect()}
    assert set(got) == {1, 2, None} and got[2] is None and got[1] is not None
    mean = {r.id: r.vector for r in text_features(df, ["id"], table, DIM, FeatureConfig("bag", "mean", 8)).collect()}
    assert mean[2] == pytest.approx(np.mean([vector(i) for i in ids(" ")], axis=0))


def test_features_with_categories_and_heads(spark, table):
    df = spark.createDataFrame([(1, "cat is", 2), (2, "at", 0)], "id int, processed string, code int")
    codes = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "code int, vector array<double>")
    heads = ((0.1,) * (DIM + 1), (0.5,) * (DIM + 1))
    out = text_features(
        df, ["id", "code"], table, DIM, FeatureConfig("bag", "heads", 8, head_weights=heads), categories={"code": (codes, 3)}
    )
    got = {(r.id, r["head"]): r.vector for r in out.collect()}
    assert len(got) == 4 and all(len(v) == DIM + 1 for v in got.values())
    assert got[1, 0][-1] == pytest.approx(2.0) and got[2, 1][-1] == pytest.approx(0.0)


def test_frequent_tokens_are_proven_or_counted_in_full(spark):
    # 40 tokens of falling frequency among 3,000 single ones, more than a summary holds.
    often = [t for i in range(40) for t in [f"f{i:02d}"] * (400 - 5 * i)]
    single = [f"s{i}" for i in range(3000)]
    words = often + single + [None, vocabulary.PAD_WORD]
    random.Random(1).shuffle(words)
    df = spark.createDataFrame([(words[i::50],) for i in range(50)], "tokens array<string>")

    def rows(**more):
        return vocabulary.build_vocabulary(df, min_count=2, **more).orderBy("idx").collect()

    for size in (12, 42, 60):
        assert rows(size=size, tracked=1000) == rows(size=size)
    found = vocabulary.frequent_counts(df, "tokens", 10, 2, 1000)
    assert {f"f{i:02d}": 400 - 5 * i for i in range(10)}.items() <= {r.token: r.n for r in found.collect()}.items()
    assert found.count() < 1500
    # The places beyond the frequent ones cannot be proven by so small a summary; a large one leaves nothing uncounted.
    assert vocabulary.frequent_counts(df, "tokens", 60, 1, 1000) is None
    assert vocabulary.frequent_counts(df, "tokens", 60, 1, 20_000).count() == 3040
    assert rows(size=60, tracked=20_000) == rows(size=60)
    empty = df.where("false")
    assert vocabulary.build_vocabulary(empty, size=9, tracked=10).count() == 2
    with pytest.raises(ValueError, match="size"):
        vocabulary.build_vocabulary(df, tracked=10)


@pytest.mark.parametrize("pooled", ["mean", "attention"])
def test_vectors_beyond_broadcasts_are_sent_once_per_group(spark, table, monkeypatch, pooled):
    w = tuple([0.5] * DIM)
    rng = random.Random(5)
    words = ["cat", "at", "is", "e", "the", "mat", "xyz", "<ca"]
    rows = [(i % 40 or None, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, processed string")
    config = FeatureConfig("bag", pooled, 8, w, w)

    def features():
        return text_features(df, ["id"], table, DIM, config, oov="unk")

    near = {r.id: r.vector for r in features().collect()}
    monkeypatch.setattr(embeddings.attach_word_vectors, "__defaults__", (None, 0))
    far = features()
    got = far.collect()
    assert len(got) == len(near) and all(r.vector == pytest.approx(near[r.id]) for r in got)
    # After the steps have met their vectors nothing is shuffled.
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan[: plan.index("Window")]


def test_vectors_beyond_broadcasts_are_not_shuffled(spark, table, monkeypatch):
    df = spark.createDataFrame([(i, f"cat at w{i % 7} xyz") for i in range(40)], "id int, processed string")
    monkeypatch.setattr(embeddings.attach_word_vectors, "__defaults__", (None, 0))
    out = text_features(df, ["id"], table, DIM, FeatureConfig("bag", "max", 8))
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    shuffled = [part for part in plan.split("\n\n") if part.strip().split("\n")[0].endswith(") Exchange")]
    assert shuffled and not any("vector" in part for part in shuffled)


def test_a_counted_vocabulary_names_the_frequent_tokens(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.choices(["a", "b", "c", " ", "UNK"], (50, 5, 1, 9, 9), k=i % 7)) for i in range(60)], "id int, tokens array<string>")
    vocab = vocabulary.build_vocabulary(df)

    def ids_(**more):
        return sorted(map(tuple, vocabulary.encode_ids(df, vocab, ["id"], **more).collect()))

    near = ids_()
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookups.lookup, "__defaults__", tuple(0 if x == 64 << 20 else x for x in lookups.lookup.__defaults__))
    assert ids_() == near
    # The tokens are not counted once more.
    monkeypatch.setattr(lookups, "hot_keys", None)
    assert ids_(counted=True) == near
    assert set(vocabulary._frequent(vocab)) == {"a", "b", "c", " ", "UNK"}
