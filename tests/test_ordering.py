import math
import random

import pytest
from pyspark.sql import functions as F

from moodmill.operators import lookup as lk
from moodmill.operators.ordering import prefix_scan, with_ordinal
from moodmill.operators.splits import _border, assign_batches, holdout_split, shuffle_rows, split_mode
from moodmill.operators import splits
from moodmill.sources.tables import read_bucketed_tokens, write_token_table


def test_ordinals_are_dense_and_in_order(spark):
    df = spark.range(10_000, numPartitions=7).select(F.xxhash64("id").alias("k"))
    rows = with_ordinal(df, [F.desc("k")]).collect()
    by_key = sorted((r.k for r in rows), reverse=True)
    assert {r.k: r.ordinal for r in rows} == {k: i for i, k in enumerate(by_key)}


def test_ordinals_of_nothing(spark):
    assert with_ordinal(spark.range(0), [F.col("id")]).count() == 0


def test_batches(spark):
    rows = assign_batches(spark.range(1000, numPartitions=5), 64, [F.col("id")]).collect()
    assert all(r.batch == r.id // 64 for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_scan_equals_a_loop(spark, parts):
    rng = random.Random(3)
    # One group holds most of the rows, one has no name, and the order is sparse, with one row without it.
    rows = [(["hot", "hot", None, f"g{i % 5}"][i % 4], i * i * 1000, rng.choice([None, rng.randint(-50, 50)])) for i in range(600)]
    rows.append(("hot", None, 7))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint").repartition(parts)
    kinds = {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}
    got = {(r.g, r.i): (r.s, r.m) for r in prefix_scan(df, ["g"], "i", kinds).collect()}
    before = {(r.g, r.i): r.m for r in prefix_scan(df, ["g"], "i", {"m": kinds["m"]}, False).collect()}
    assert len(got) == len(rows)
    total, low = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        assert before[g, i] == low.get(g)
        if v is not None:
            total[g] = total.get(g, 0) + v
            low[g] = min(low.get(g, v), v)
        assert got[g, i] == (total.get(g), low.get(g))


def test_prefix_scan_over_many_partitions(spark):
    df = spark.range(5000, numPartitions=9).select(F.lit(None).cast("string").alias("g"), "id", F.lit(1).alias("v"))
    rows = prefix_scan(df, ["g"], "id", {"s": ("sum", F.col("v"))}).collect()
    assert sorted((r.id, r.s) for r in rows) == [(i, i + 1) for i in range(5000)]


@pytest.mark.parametrize("share, n", [(0.25, 1003), (0.0, 50), (1.0, 50), (0.1, 10), (0.25, 0)])
def test_holdout_is_exact_and_repeatable(spark, share, n):
    df = spark.range(n)
    val = {r.id for r in split_mode(holdout_split(df, "id", share), "val").collect()}
    train = {r.id for r in split_mode(holdout_split(df, "id", share), "train").collect()}
    assert len(val) == -(-share * n // 1)
    assert not val & train and len(val | train) == n
    again = {r.id for r in split_mode(holdout_split(df.repartition(3), "id", share), "val").collect()}
    assert val == again
    if 0 < share < 1 and n > 100:
        assert val != {r.id for r in split_mode(holdout_split(df, "id", share, seed=1), "val").collect()}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_groups_are_on_one_side(spark, share, monkeypatch):
    """A hot group with a third of the rows, null and empty groups, repeated rows; also with a descent over several prefixes."""
    monkeypatch.setattr("moodmill.operators.splits._BORDER_ROWS", 3)
    groups = ["hot"] * 100 + [None] * 7 + [""] * 5 + [f"g{i % 90}" for i in range(188)]
    df = spark.createDataFrame([(i // 2, g) for i, g in enumerate(groups)], "id int, text string")
    rows = holdout_split(df, "id", share, group="text").collect()
    sides, sizes = {}, {}
    for r in rows:
        sides.setdefault(r.text, set()).add(r.is_val)
        sizes[r.text] = sizes.get(r.text, 0) + 1
    assert len(rows) == 300 and all(len(s) == 1 for s in sides.values())
    wanted, val = math.ceil(share * 300), sum(r.is_val for r in rows)
    taken = [n for g, n in sizes.items() if sides[g] == {True}]
    assert wanted <= val and (not taken or val - wanted < max(taken))
    assert holdout_split(df.where("false"), "id", share, group="text").count() == 0
    again = holdout_split(df.repartition(5), "id", share, group="text").where("is_val").count()
    assert again == val


def test_holdout_refuses_a_border_among_equal_ids(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("id"))
    with pytest.raises(ValueError, match="not unique"):
        holdout_split(df, "id", 0.23)


def test_border_descends_when_a_prefix_is_large(spark, monkeypatch):
    monkeypatch.setattr(splits, "_BORDER_ROWS", 3)
    keys = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"))
    ordered = sorted(r.k for r in keys.collect())
    for share in (0.01, 0.333, 0.75):
        assert _border(keys, share) == ordered[-(-share * 5000 // 1).__int__() - 1]


def test_shuffle_depends_on_the_epoch(spark):
    first, second = ([r.id for r in shuffle_rows(spark.range(200), "id", epoch=e).collect()] for e in (0, 1))
    assert first != second and sorted(first) == sorted(second) == list(range(200))
    assert first == [r.id for r in shuffle_rows(spark.range(200).repartition(4), "id", epoch=0).collect()]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_ways_agree_under_skew(spark, how):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(3000).select("id", key.alias("k"))
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 40)]], "k string, v int")
    small = lk.lookup(facts, table, "k", how)
    large = lk.lookup(facts, table, "k", how, max_bytes=0, hot_share=0.1)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    a, b = (sorted(map(str, d.select("id", "k", "v").collect())) for d in (small, large))
    assert a == b and len(a) > 1000
    assert lk.hot_keys(facts, "k", 0.1) == ["hot"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_pieces_leave_the_facts_in_place(spark, how):
    key = F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(3000).select("id", key.alias("k"))
    rows = [(f"k{i}", None if i == 3 else [float(i)] * 4, i) for i in range(40)]
    table = spark.createDataFrame([*rows, ("k7", [1.5], 99), (None, [0.0], 0)], "k string, v array<float>, n int")
    large = lk.lookup(facts, table, "k", how, max_bytes=-(-lk.table_bytes(table) // 5))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 5 and "hashpartitioning" not in plan
    small = lk.lookup(facts, table, "k", how)
    assert large.columns == small.columns
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_bucketed_table_is_not_shuffled(spark, tmp_path, how):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(3000).select("id", key.alias("token"))
    rows = [(" ", 0), ("UNK", 1), ("hot", 2), *[(f"k{i}", i + 3) for i in range(40)]]
    plain = spark.createDataFrame([(t, i, [float(i)] * 3) for t, i in rows], "token string, idx long, vector array<double>")
    name = f"tokens_{how}"
    write_token_table(plain, name, str(tmp_path / "tokens"), 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, dim = read_bucketed_tokens(spark, name)
        joined = lk.lookup(facts, table, "token", how, max_bytes=0, hot_share=0.1, bucketed=True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, joined.select("id", "token", "idx", "vector").collect()))
        # One shuffle in the plan, that of the facts; the table is read by its buckets.
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        assert "Bucketed: true" in joined._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE {name}")
    small = lk.lookup(facts, plain, "token", how)
    assert dim == 3 and len(found) > 1000
    assert found == sorted(map(str, small.select("id", "token", "idx", "vector").collect()))


def test_salts_spread_the_hot_key(spark):
    facts = spark.range(3000).select("id", F.lit("hot").alias("k"))
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = lk.lookup(facts, table, "k", "left", max_bytes=0, salts=16)
    salt = F.pmod(F.xxhash64("id", "k"), F.lit(16))
    assert joined.count() == 3000 and facts.select(salt).distinct().count() == 16


def test_table_size_grows_with_its_rows(spark):
    table = spark.range(100).select(F.col("id").cast("string").alias("token"), F.array_repeat(F.lit(1.0), 64).alias("vector"))
    assert 100 * 64 * 8 < lk.table_bytes(table) < 100 * 1000
