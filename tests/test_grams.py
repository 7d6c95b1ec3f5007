"""Grams in Arrow batches, against plain Python, and the two ways to meet a language model."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from moodmill.functions import grams
from moodmill.operators.language import gram_counts, language_fit, language_predict

LETTERS = "ab\x00é漢😀 \n"


@pytest.fixture(params=[(3, 0), (1 << 21, 1 << 23)])
def bounds(request, monkeypatch):
    """Short stretches with searched tables, and the fixed values."""
    monkeypatch.setattr(grams, "STEP", request.param[0])
    monkeypatch.setattr(grams, "DENSE", request.param[1])


def _texts(rng, n):
    return [None if rng.random() < 0.1 else "".join(rng.choices(LETTERS, k=rng.randint(0, 12))) for _ in range(n)]


def test_cuts_are_counted_over_code_points(bounds):
    rng = random.Random(1)
    for _ in range(30):
        texts, got = _texts(rng, 6), Counter()
        for cuts, counts in grams.cut_counts(pa.array(texts, pa.string()), 3):
            for cut, n in zip(grams.cut_texts(cuts, 3).to_pylist(), counts):
                got[cut] += int(n)
        assert got == Counter(t[i : i + 3] for t in texts if t for i in range(len(t)))


def test_sums_of_a_text_are_those_of_its_grams(bounds):
    rng = random.Random(2)
    for _ in range(30):
        known = sorted({"".join(rng.choices(LETTERS[:6], k=rng.randint(1, 3))) for _ in range(8)})
        entries = {(g, c): rng.random() for g in range(len(known)) for c in range(2) if rng.random() < 0.7}
        at = np.array(list(entries), np.int64).reshape(-1, 2)
        weights = grams.GramWeights(pa.array(known), at[:, 0], at[:, 1], np.array(list(entries.values())), 2)
        texts = _texts(rng, 6)
        got = weights.reader()(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            found = [known.index(t) for t in (text[i : i + s] for s in (1, 2, 3) for i in range(len(text or "") - s + 1)) if t in known]
            assert got[0, k] == len(found)
            assert np.allclose(got[1:, k], [sum(entries.get((g, c), 0) for g in found) for c in range(2)])


def test_both_ways_agree_and_a_small_model_moves_no_text(spark):
    labelled = spark.createDataFrame(
        [("the cat", "en"), ("a cat 😀", "en"), ("die katze", "de"), ("der hund", "de"), ("le chat", "fr"), (None, "fr")], "text string, lang string"
    )
    model = language_fit(labelled)
    asked = spark.createDataFrame([(t,) for t in ["cat", "katze", "chat 😀", "x", "漢字", "", None, "cat"]], "t string")
    near, far = language_predict(asked, model, "t"), language_predict(asked, model, "t", max_bytes=0)

    def rows(df):
        return sorted((r.t is None, r.t, r.lang, round(r.prob, 9)) for r in df.collect())

    assert rows(near) == rows(far)
    assert "Exchange" not in near._jdf.queryExecution().toString()


def test_languages_of_any_type_and_null_keep_their_grams(spark):
    rows = spark.createDataFrame([("ab", 1), ("ab", None), ("b", None), (None, 1)], "text string, lang int")
    got = {(r.lang, r.gram): r.n for r in gram_counts(rows).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (1, "ab"): 1, (None, "a"): 1, (None, "b"): 2, (None, "ab"): 1}
