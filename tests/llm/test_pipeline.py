"""The pipeline against the stages one after the other in plain Python."""

import pathlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from moodmill.llm import sharding
from moodmill.llm.oracle import ORACLE_SQL
from tests.llm import brute

DATA = pathlib.Path("/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "source_mix", "shards"]


def test_run(spark):
    duck = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    docs = {r[0]: r for r in duck.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()}
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op5_quality_rules']}) WHERE kept").fetchall()}
    prints = {k: brute.fingerprint(docs[k][1]) for k in sorted(kept)}
    kept = set(brute.components(prints, brute.close).values())
    leaks = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op8_decontamination']}) WHERE contaminated").fetchall()}
    kept -= leaks

    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= kept and max(copies.values()) <= 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for k in kept:
        source, size = docs[k][3], len(brute.WORD.findall(docs[k][1]))
        sizes[source] += size
        taken[source] += size * copies[k]
        largest[source] = max(largest[source], size)
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.1
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    # Every source with the same share of its size open gets words by weight, up to twice its size.
    open_ = [s for s in sizes if taken[s] < 2 * sizes[s] - largest[s]]
    level = [taken[s] / weights[s] for s in open_]
    slack = max(largest[s] / weights[s] for s in open_)
    assert max(level) - min(level) <= 2 * slack
    for r in rows:
        assert (r.doc_id, r.text, r.lang, r.source, r.n_chars) == docs[r.doc_id]
    assert sorted(r.row_number for r in rows) == list(range(len(rows)))
    assert all(sharding.row_of(r.shard, r.slot, len(rows)) == r.row_number for r in rows[:50])
    counts = Counter(r.shard for r in rows)
    assert len(counts) == sharding.SHARDS and max(counts.values()) - min(counts.values()) <= 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(DATA)).columns == docs.columns
