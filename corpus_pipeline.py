"""From raw documents to a sharded training mix: five stages, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodmill.llm.common import durable, given
from moodmill.llm.decontaminate import decontaminate
from moodmill.llm.mixing import mixed
from moodmill.llm.quality import quality_filter
from moodmill.llm.sharding import sharded
from moodmill.llm.simhash import first_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed and the certified rules keep; cutoffs come from ``labels``."""
    return quality_filter(docs, given(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of 4-word shingles within 4 bits."""
    return first_of_each(docs, words=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with ``benchmark``."""
    return decontaminate(docs, given(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its row number, shard and slot."""
    return sharded(docs, ["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

# The SimHash components and the permutation cannot be put as SQL; a test has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's table is written and read again."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
