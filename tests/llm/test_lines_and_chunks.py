import random

import numpy as np
from hypothesis import given, settings, strategies as st

from moodmill.llm import chunk_dedup as c, line_dedup as l

LONG = "a line of more than forty code points in all, really"


def test_line_keys():
    lines, digests = l.line_keys(f" \t{LONG}\x0b\nshort\n{LONG.upper()}\n" + "é" * 39 + "\n" + "é" * 40)
    assert len(lines) == 5 and digests[0] == digests[2] is not None
    assert [x is None for x in digests] == [False, True, False, True, False]
    assert l.line_keys(None) == ([b""], [None])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=30), min_size=1, max_size=6))
def test_filter_never_misses(batches):
    both = l.RepeatFilter(l.MIN_BITS)
    seen = {}
    for batch in batches:
        pairs = np.array([[x * 7919, x * 104729 + 5] for x in batch], dtype=np.uint64).reshape(-1, 2)
        if len(pairs):
            both.add(pairs)
        for x in batch:
            seen[x] = seen.get(x, 0) + 1
    again = [x for x, n in seen.items() if n > 1]
    if again:
        assert both.repeated(np.array([[x * 7919, x * 104729 + 5] for x in again], dtype=np.uint64)).all()


def test_dedup_lines(spark):
    rows = [(i, f"{LONG}\nown line of document number {i} which is long enough\n  {LONG.upper()} ", i) for i in range(6)]
    rows += [(20, None, 0), (21, "", 0), (22, "x\n\nx", 0), (None, LONG, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").repartition(4)
    got = {r.doc_id: r for r in l.dedup_lines(docs).collect()}
    assert got[5].text == rows[5][1] and got[5].n_dropped == 0
    for i in range(5):
        assert got[i].text == rows[i][1].split("\n")[1] and (got[i].n_lines, got[i].n_dropped) == (3, 2)
    assert got[20].text is None and got[20].n_lines == 1 and got[21].n_lines == 1 and got[22].n_lines == 3
    assert got[None].text == LONG and got[None].n_dropped == 0
    # Four documents are too few; a repeated row is the same document.
    few = docs.where("doc_id < 4")
    assert l.dedup_lines(few.unionByName(few)).where("n_dropped > 0").count() == 0
    assert l.dedup_lines(docs.where("false")).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    # A filter that suspects every line, as one far beyond its size would.
    monkeypatch.setattr(l, "repeat_filter", lambda rows, bits, min_chars: np.full(bits // 8, 255, dtype=np.uint8))
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line number {rng.randrange(30)} with enough characters to count here" for _ in range(4))) for i in range(40)]
    got = {r.doc_id: r.text for r in l.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {}
    for i, t in rows:
        for x in t.split("\n"):
            held.setdefault(x, set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(held[x]) < 5 or max(held[x]) == i) for i, t in rows}
    assert got == want


def plain_gear(raw):
    return [sum((int(c.GEAR[raw[i - k]]) << k) for k in range(min(i + 1, c.WINDOW_BYTES))) & 0xFFFFFFFF for i in range(len(raw))]


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_gear_hash(raw):
    assert c.gear_hash(raw).tolist() == plain_gear(raw)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700).filter(lambda b: b" " not in b), max_size=30))
def test_chunks_cover_all_words(words):
    bounds = c.chunk_bounds(words)
    assert bounds[0] == 0 and bounds[-1] == len(words)
    assert all(a < b for a, b in zip(bounds, bounds[1:]))


def prose(rng, n):
    return [rng.choice(["lo", "ra", "mi", "ten", "sol"]) * rng.randrange(1, 4) + str(rng.randrange(3000)) for _ in range(n)]


def test_chunks_do_not_move():
    rng = random.Random(2)
    text = prose(rng, 400)

    def digests(words):
        raw = [w.encode() for w in words]
        b = c.chunk_bounds(raw)
        return {b" ".join(raw[x:y]) for x, y in zip(b, b[1:])}

    before, after = digests(text), digests([*text[:100], "inserted", "words", *text[100:]])
    assert len(before - after) <= 3


def test_repeated_passages(spark):
    rng = random.Random(1)
    shared = prose(rng, 55)
    rows = []
    for i in range(20):
        own = prose(rng, 120)
        rows.append((i, " ".join([*own[:40], *shared, *own[40:]]) if i % 4 == 1 else " ".join(own), "x"))
    rows += [(50, None, "x"), (51, "", "x"), (None, rows[1][1], "x"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = c.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {5, 9, 13, 17} and {r.first for r in got} == {1}
    assert all(40 <= r.start and r.stop <= 95 and r.stop - r.start >= 15 for r in got)
    cut = c.dedup_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts[5].split()) < 140 and texts[1] == rows[1][1] and texts[50] is None and texts[0] == rows[0][1]
    assert c.repeated_passages(docs.where("false")).count() == 0


def test_query_equals_plain(spark):
    import pathlib

    from moodmill.llm.queries import QUERIES

    data = pathlib.Path("/root/testdata/sf0.001")
    if not data.exists():
        return
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    cut, first = {}, {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        bounds = c.chunk_bounds(words)
        cut[i] = [(a, b, b" ".join(words[a:b])) for a, b in zip(bounds, bounds[1:])]
        for *_, chunk in cut[i]:
            first.setdefault(chunk, i)
    want = {
        (i, *s) for i, held in cut.items()
        for s in c.stretches([{"start": a, "stop": b, "first": first[x]} for a, b, x in held if first[x] < i])
    }
    got = QUERIES["op4_chunk_dedup"](spark, str(data)).collect()
    assert {(r.doc_id, r.start_word, r.stop_word, r.first_doc_id) for r in got} == want and len(got) == len(want) > 0


def test_cut_passages():
    assert c.cut_passages("  a b\n c  d e", [(1, 3)]) == "  a d e"
    assert c.cut_passages("a b", [(0, 2)]) == ""
