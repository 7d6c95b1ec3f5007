import pathlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from moodmill.llm import simhash
from tests.llm import brute

DATA = pathlib.Path("/root/testdata/sf0.001")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\t\n\x0b\x1cß", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_fingerprint_of_nothing():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n\t") == 0


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**11])
def test_tables_cover_the_radius(n):
    masks = simhash.block_tables(n)
    rng = np.random.default_rng(n % 97)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("family", [0, 40, 3000])
def test_linked_equals_all_pairs(family):
    rng = np.random.default_rng(family)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = prints[:60] ^ np.uint64(0b1111)
    far = prints[60:120] ^ np.uint64(0b11111)
    base = np.uint64(0x123456789ABCDEF0)
    spread = base ^ (np.uint64(1) << rng.integers(0, 64, family).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, family).astype(np.uint64)
    )
    values = np.unique(np.concatenate([prints, near, far, spread]))
    label = simhash.linked(values, np.zeros(len(values), dtype=np.int64))
    want = np.arange(len(values))
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
    changed = True
    while changed:  # labels spread over all pairs until nothing changes
        changed = False
        for i in range(len(values)):
            close = np.flatnonzero(np.abs(bits - bits[i]).sum(axis=1) <= 4)
            least = want[close].min()
            if (want[close] != least).any():
                want[close] = least
                changed = True
    assert (label == want).all()


def test_linked_keeps_groups_apart():
    values = np.array([1, 3, 1, 3], dtype=np.uint64)
    assert simhash.linked(values, np.array([0, 0, 1, 1])).tolist() == [0, 0, 2, 2]


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 90), (101, 100), (110, 101), (110, 95)] + [(500 + i, 499) for i in range(1, 200)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = brute.components({n: n for e in chain for n in e}, lambda a, b: (max(a, b), min(a, b)) in set(chain))
    assert found == {k: v for k, v in want.items() if k != v}


def test_edges_of_the_table(spark):
    rows = [(1, "a b c d e f", 7), (2, "A  b\nc d e F", 8), (2, "A  b\nc d e F", 8), (3, None, 1), (4, "", 2), (5, " ", 3), (None, "a b c d e f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 3), (False, 4, 3), (False, 5, 3), (True, 0, 1)]
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert simhash.first_of_each(docs.where("false")).count() == 0


def test_texts_under_one_key_are_judged_apart(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one, "x"), (5, other, "x"), (5, other, "x"), (6, other, "y"), (5, other, None), (None, one, "u"), (None, one, "v")]
    for order in (rows, rows[::-1]):
        kept = simhash.first_of_each(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, one), (5, one), (5, other)]
        assert [r for r in kept if r.text == other] == [r for r in (first if order is not rows else kept) if r.text == other]
        first = kept


def test_words_and_radius_are_parameters(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(20, 120)))]
        for _ in range(8):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = f"x{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(words[int(rng.integers(0, 3)) :])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for words, radius in ((simhash.SHINGLE_WORDS, simhash.RADIUS), (2, 7)):
        prints = {k: simhash.fingerprint(t, words) for k, t in texts.items()}
        want = brute.components(prints, lambda a, b: brute.close(a, b, radius))
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, words=words, radius=radius).collect()}
        assert found == want
        kept = simhash.first_of_each(frame, words=words, radius=radius)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_radius_beyond_the_counters_is_refused():
    with pytest.raises(ValueError):
        simhash.block_tables(10, simhash.MOST_RADIUS + 1)


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(1, long, 1, 2, "x"), (2, long, 3, 4, "y"), (3, None, 5, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, _root int, fp string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.a, r._root, r.fp) for r in kept.select("doc_id", "a", "_root", "fp").collect()) == [(1, 1, 2, "x"), (3, 5, 6, "z")]


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 50)
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([
        np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)),
        rng.integers(0, 1 << 63, 100, dtype=np.uint64),
    ])).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, len(values))).collect()}
    got = {v: roots.get(v, v) for v in values.tolist()}
    want = brute.components({v: v & (1 << 64) - 1 for v in values.tolist()}, brute.close)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_query_equals_all_pairs(spark):
    from moodmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {k: brute.fingerprint(t) for k, t in texts.items()}
    want = brute.components(prints, brute.close)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, str(DATA)).collect()}
    assert got == {k: (format(prints[k], "016x"), want[k]) for k in texts}
