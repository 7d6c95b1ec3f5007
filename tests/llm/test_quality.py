import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from moodmill.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(re.findall("[A-Z!]", text or "")),
            len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c a b c a", "a a a a", "# x $%\n# x $%\n\n# x $%", "É! AB\x0bc\x1cd", "a\rb\n" * 30]

    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.text(alphabet="aAb #!|\n\té", max_size=60), min_size=20, max_size=20))
    def run(more):
        every = [*texts, *more]
        frame = spark.createDataFrame([(i, t, 3) for i, t in enumerate(every)], "doc_id long, text string, other int")
        for r in q.text_counts(frame).collect():
            assert tuple(r[c] for c in q.COUNTS) == plain(every[r.doc_id]) and r.other == 3

    run()


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.05), (10, 3, 0.5), (1500, 2, 0.005), (2000, 9, 0.005), (100000, 430, 0.005), (50, 49, 0.99), (0, 0, 0.1), (5, 4, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(q.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
    if not n or k >= n * p:
        assert got == 1.0
    else:
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        assert math.isclose(got, sum(map(math.exp, logs)), rel_tol=1e-6)


def test_cutoffs(spark):
    # Ratios in hundredths: good rows at most 20, bad rows at 60; too few labels in "fr"; a null stratum.
    rows = [(i, "en" if i % 2 else None, (i % 21) / 100) for i in range(8000)] + [(10000 + i, "en", 0.6) for i in range(50)]
    rows += [(20000 + i, "fr", 0.9) for i in range(30)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, symbol_ratio double").withColumns(
        {r: F.lit(0.0) for r in q.RATIOS[1:]} | {"n_words": F.lit(100), "n_repeat_words": F.lit(0)}
    )
    labels = [(i, 1) for i, _, _ in rows if i < 10000] + [(i, 0) for i, _, _ in rows if i >= 10000] + [(3, 0), (None, 0), (4, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    cutoffs = q.certified_cutoffs(scored, labels)
    found = {r.lang: r.max_symbol_ratio for r in cutoffs.collect()}
    assert found == {"en": 0.2}
    kept = q.judged(scored, cutoffs)
    assert kept.where("not kept").select(F.min("doc_id"), F.max("doc_id"), F.count("*")).first() == (10000, 10049, 50)
    assert q.certified_cutoffs(scored, labels.where("false")).count() == 0
    assert q.judged(scored, q.certified_cutoffs(scored, labels.where("false"))).where("kept").count() == len(rows)


def test_filter(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "en", 5), (2, "few words", "en", 5), (3, None, "en", 5), (4, "a b c " * 30, None, 5), (1, good, "en", 5), (None, good, None, 5), (6, "", "de", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = q.quality_filter(docs, labels)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert q.quality_filter(docs.where("false"), labels.where("false")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
