import math

import numpy as np
import pytest

from moodmill.llm import mixing as m, sharding as s
from moodmill.llm.common import ranked


def rows_of(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", "c", None][i % 4], "x") for i in range(400)]
    rows += [(1000 + i, "word " * 30, "hot", "x") for i in range(300)]
    rows += [(9, "w " * 9, "b", "x"), (5000, None, "a", "x"), (None, "w w", "a", "x"), (5001, "\n\t", "void", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [n for n in names if n not in capped]
        level = (total - sum(2 * sizes[n] for n in capped)) / sum(weight[n] for n in open_) if open_ else 0
        more = {n for n in open_ if weight[n] * level > 2 * sizes[n]}
        if not more:
            return {n: 2.0 * sizes[n] if n in capped else weight[n] * level for n in names}
        capped |= more


def test_mixture(spark):
    docs = rows_of(spark)
    got = m.mixture(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = plain_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for source, n in taken.items():
        assert abs(n - targets[source]) <= largest[source] + 1e-6
    again = m.mixture(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed(spark):
    docs = rows_of(spark)
    want = {}
    for r in m.mixture(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    mix = m.mixed(docs)
    assert mix.columns == docs.columns
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert m.mixed(docs.where("false")).count() == 0 and m.mixture(docs.where("false")).count() == 0


def test_native_plan(spark):
    plan = m.mixture(rows_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_count(spark):
    cases = [("", 0), (None, 0), (" a\x0b b\r\n", 2), ("a\u00a0b", 1), ("\n", 0), ("x", 1)]
    frame = spark.createDataFrame(cases, "text string, n int")
    assert all(r.got == r.n for r in frame.select("n", m.word_count(frame["text"]).alias("got")).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 40, 63, 64, 65, 1000, 4097])
def test_permutation(n):
    p = s.Permutation(n)
    numbers = np.arange(n)
    moved = p(numbers)
    assert sorted(moved.tolist()) == numbers.tolist()
    assert p.inverse(moved).tolist() == numbers.tolist()
    if n > 500:
        assert abs(np.corrcoef(numbers, moved)[0, 1]) < 0.1
        assert moved.tolist() != s.Permutation(n, seed=1)(numbers).tolist()


def test_sharded(spark):
    rows = [(i * 3 % 101, None if i % 9 == 0 else "t" * (i % 5), i) for i in range(101)] + [(None, "x", 1), (7, "dup", 2), (7, "dup", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long").repartition(4)
    got = s.sharded(docs, ["doc_id"], shards=8).collect()
    assert sorted(r.row_number for r in got) == list(range(104))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert s.row_of(r.shard, r.slot, 104, 8) == r.row_number
    assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(13)) for x in slots.values())
    order = sorted(got, key=lambda r: r.row_number)
    assert [r.doc_id for r in order] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    again = s.sharded(docs.repartition(2), ["doc_id"], shards=8).collect()
    place = lambda r: (r.doc_id or -1, r.text or "", r.shard, r.slot)
    assert sorted(map(place, got)) == sorted(map(place, again))
    assert s.sharded(docs.where("false"), ["doc_id"]).count() == 0


def test_ranked(spark):
    frame = spark.createDataFrame([(x % 7, x) for x in range(50)], "a int, ordinal int").repartition(6)
    got = ranked(frame, [frame["a"], frame["ordinal"].desc()], "at").collect()
    want = sorted(((x % 7, -x) for x in range(50)))
    assert [(r.a, -r.ordinal) for r in sorted(got, key=lambda r: r.at)] == want
    assert sorted(r.at for r in got) == list(range(50))


def test_ranked_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(x, -x, str(x)) for x in range(30)], "a int, _PLACED int, _placed_ string").repartition(3)
    got = ranked(frame, [frame["a"]], "at").collect()
    assert sorted(map(tuple, got)) == [(x, -x, str(x), x) for x in range(30)]
    docs = spark.createDataFrame([(x, "t", x * 10) for x in range(30)], "doc_id long, text string, _placed int")
    assert sorted((r.doc_id, r._placed) for r in s.sharded(docs, ["doc_id"]).collect()) == [(x, x * 10) for x in range(30)]
