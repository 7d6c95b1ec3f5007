import random

import pytest
from hypothesis import given, settings, strategies as st

from moodmill.llm import decontaminate as d


def plain(items, words, window=10):
    windows = {}
    for name, item in items:
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if size else 0):
            windows.setdefault(tuple(item[i : i + size]), set()).add(name)
    hit, names = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            found = windows.get(tuple(words[i : i + size]))
            if found:
                names |= found
                hit |= set(range(i, i + size))
    return hit, names


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"x"]), max_size=40), st.integers(1, 4))
def test_search_equals_plain(items, text, window):
    named = [(str(i), w) for i, w in enumerate(items)]
    spans, names = d.SuffixAutomaton(named, window).search(text)
    hit, want = plain(named, text, window)
    assert {p for a, b in spans for p in range(a, b)} == hit and names == want
    assert spans == d.merged(spans)


def test_words():
    assert d.words_of("It's A-1 Straße\x00x y") == [b"it", b"s", b"a", b"1", "straße".encode(), "x y".encode()]
    assert d.words_of(None) == d.words_of("") == []


@pytest.fixture()
def tables(spark):
    rng = random.Random(3)
    item = [rng.choice("abcdefgh") * 2 + str(i) for i in range(14)]
    docs = [
        (1, "start " + " ".join(item).upper() + " end.", "x"), (2, "clean text", "x"), (3, None, "x"), (4, "", None),
        (5, "short item!", "x"), (5, "short item!", "x"), (6, " ".join(item[:9]), "x"), (7, "w " * 40 + " ".join(item[2:13]), "x"),
    ]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, items string"),
        spark.createDataFrame([(1, " ".join(item)), (2, "Short, ITEM"), (3, ""), (4, None), (5, " ".join(item))], "item_id long, text string"),
    )


def test_contamination(tables):
    docs, benchmark = tables
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, benchmark).collect())
    assert got == [(1, 16, 14, ["1", "5"]), (2, 2, 0, []), (3, 0, 0, []), (4, 0, 0, []), (5, 2, 2, ["2"]), (5, 2, 2, ["2"]),
                   (6, 9, 0, []), (7, 51, 11, ["1", "5"])]
    # One automaton per item gives the same.
    blocks = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.contamination(docs, benchmark, block_words=1).collect())
    assert blocks == got


def test_decontaminate(tables):
    docs, benchmark = tables
    assert sorted(r.doc_id for r in d.decontaminate(docs, benchmark).collect()) == [2, 3, 4, 6]
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, benchmark, max_coverage=0.5).collect()}
    assert sorted(cut) == [2, 3, 4, 6, 7] and cut[7] == "w " * 40 and cut[3] is None and cut[2] == "clean text"
    every = {r.doc_id: r.text for r in d.decontaminate(docs, benchmark, max_coverage=1.0).collect()}
    assert every[1] == "start  end." and every[5] == "short item!"  # two words are below the least span
    assert d.decontaminate(docs, benchmark.where("false")).count() == 8
    assert d.decontaminate(docs.where("false"), benchmark).columns == docs.columns
