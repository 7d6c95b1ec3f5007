"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from moodmill.llm import (
    alignment, chunk_dedup, decontaminate, exact_dedup, fill_middle, line_dedup, mixing, quality, sharding, simhash, token_store,
    toxicity, url_filter,
)
from moodmill.llm.common import durable, given
from moodmill.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(given(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(given(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given(spark, sf_dir, "pages").select("page_id", "url")
    # The labels of the same number stand for the page: low quality is unwanted.
    labels = given(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    wanted = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality"))
    labelled = pages.join(wanted, "page_id").select("url", (F.col("quality") == 0).alias("unwanted"))
    return url_filter.judged_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "mined")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.repeated_passages(given(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"),
                        F.col("first").alias("first_doc_id"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = durable(quality.with_ratios(quality.text_counts(docs)).drop("text"), "quality")
    cutoffs = durable(quality.certified_cutoffs(scored, given(spark, sf_dir, "labels")), "cutoffs")
    return quality.judged(scored, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(given(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        token_store.write_store(given(spark, sf_dir, "documents"), path, file.read())
    return token_store.read_store(spark, path, with_ids=False).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "row"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    rows = given(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole).alias("text_crc32")
    )
    return sharding.sharded(rows, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    model = toxicity.fit(docs, given(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        a_json = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        b_model = file.read()
    found, _ = alignment.aligned(given(spark, sf_dir, "documents"), a_json, b_model)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(given(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(given(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_token_store": op7_token_store,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_fill_middle": op13_fill_middle,
}
