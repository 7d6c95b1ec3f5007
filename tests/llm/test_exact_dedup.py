import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill.llm import exact_dedup
from moodmill.llm.exact_dedup import FuseFilter


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    made = FuseFilter.from_bytes(FuseFilter.of(np.concatenate([keys, keys[: n // 2]])).to_bytes())
    assert made.holds(keys).all()
    assert made.holds(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)).mean() < 0.01
    if n == 50_000:
        assert len(made.cells) < 1.35 * n


def plain(rows):
    """(key, text) to sorted (key, keep, size, kept, digest); one row of equal keys and texts stays."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        first = True
        for k in sorted(keys, key=lambda k: k != keep):
            out.append((k, keep, len(keys), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def collected(frame):
    names = frame.columns
    return sorted(((*r[:4], r[4].hex()) for r in frame.collect()), key=str), names


ROWS = (
    [(i, f"text {i % 40}") for i in range(300)] + [(None, None), (None, ""), (7, None), (7, "alone"), (7, "alone"), (None, "none")]
    + [(None, "none"), (500, "a" * 300_000), (501, "a" * 300_000), (502, "a" * 299_999 + "b"), (503, "A"), (504, "a"), (505, "a ")]
    + [(9, "hot")] * 400
)


@pytest.mark.parametrize("batches", [1, 3])
def test_groups(spark, batches):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in ROWS], "doc_id long, text string, n int, digest string").repartition(7)
    got, names = collected(exact_dedup.exact_groups(docs, batches=batches))
    assert names == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    assert got == plain(ROWS)


def test_texts_under_one_digest_are_told_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")

    def weak(text):
        return F.substring(exact_dedup.sha256(text), 1, 1)

    found = exact_dedup.exact_groups(docs, digest=weak).drop("digest")
    want = sorted((r[:4] for r in plain(ROWS)), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want
    beyond = exact_dedup.exact_groups(docs, screen_bytes=0).drop("digest")
    assert sorted(map(tuple, beyond.collect()), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), ("c", "u")], "name string, body string")
    got = {(r.name, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, "name", "body").collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}


def test_snapshots_are_immutable_and_found_again(spark, tmp_path):
    def batch(texts):
        rows = [(t, 1, i, i) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "t string, n long, keep long, keep_row long").select(
            exact_dedup.sha256(F.col("t")).alias("digest"), "n", "keep", "keep_row"
        )

    store = exact_dedup.DigestStore(spark, str(tmp_path / "store"))
    store.add(batch(["a", "b"]))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "000000").rglob("*.parquet")}
    again = exact_dedup.DigestStore(spark, str(tmp_path / "store"))
    assert again.buckets == store.buckets == [1]
    assert again.add(batch(["b", "c"])).count() == 2
    assert spark.read.parquet(str(tmp_path / "store/000001/digests")).count() == 1
    assert spark.read.parquet(str(tmp_path / "store/000001/again")).count() == 1
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "000000").rglob("*.parquet")}
    third = exact_dedup.DigestStore(spark, str(tmp_path / "store"))
    wanted = {hashlib.sha256(x.encode()).digest() for x in "abc"}
    held = third.known(batch(list("abcdefgh")).withColumn("h", F.xxhash64("digest")))
    assert {bytes(r.digest) for r in held.collect()} == wanted
