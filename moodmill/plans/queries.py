"""The registered queries: one or more per operator, over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from moodmill.functions import text as clean
from moodmill.functions import tokens as tok
from moodmill.functions.vectors import dot
from moodmill.operators import classifier, dedup, embeddings, emoji, evaluation, language, pooling, splits, vocabulary
from moodmill.operators import subwords, training_rounds
from moodmill.operators.lookup import lookup
from moodmill.operators.ordering import with_ordinal
from moodmill.plans import relations as rel
from moodmill.plans.preparation import labelled_tweets, prepare
from moodmill.plans.training import FeatureConfig, text_features, train_and_evaluate, word_samples
from moodmill.session import durable, scratch_path
from moodmill.sources import archive, tables
from moodmill.streaming.incremental import prepare_incremental
from moodmill.streaming.running_average import running_average_stream

DIM = 64
CLASSES = 10
MAX_LEN = 100
BATCH = 512
FREQUENT = 300  # rows of the vocabulary of frequent words
WIDE = 5  # times the vector stands in the wide queries, so that it is beyond one aggregate per number
# Attention vectors of the queries, by a rule of head and dimension.
HEADS = [[((i * (h + 1)) % 7 - 3) / 10 for i in range(DIM)] for h in range(3)]

# Weights of one layer of a perceptron, by a rule of their place.
GIVEN = [((k * 7) % 11 - 5) / 10 for k in range(CLASSES * (DIM + 1))]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    """Add a query under a name that starts with the id of its operator."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def digest(c: Column) -> Column:
    """One comparable value of a whole array, order included."""
    return F.md5(F.array_join(c.cast("array<string>"), "|"))


def rounded(c: str) -> Column:
    """A rounded mean; the shift keeps exact decimal ties from falling to either side."""
    return F.round(F.col(c) + 1e-9, 5).alias(c)


def vector_columns(vector: str = "vector", dim: int = DIM) -> list[Column]:
    """Comparable numbers of a vector: both ends, the sum, and a sum weighted by position."""
    v = F.col(vector)
    return [
        F.round(F.get(v, F.lit(0)).cast("double"), 5).alias("v_first"),
        F.round(F.get(v, F.lit(dim - 1)).cast("double"), 5).alias("v_last"),
        F.round(dot(v, [1.0] * dim), 5).alias("v_sum"),
        F.round(dot(v, [float(i + 1) for i in range(dim)]), 4).alias("v_weighted"),
    ]


# Sources and sinks


@register("a1_read_tweets")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive.read_tweets(spark, rel.archive(spark, sf_dir))
    return read.select(rel.source_of(F.col("source_file")).alias("source_file"), "text")


@register("a2_split_bad_records")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = archive.read_archive(spark, rel.archive(spark, sf_dir))
    _, bad = archive.split_bad_records(archive.parse_records(lines))
    return bad.select(rel.source_of(F.col("source_file")).alias("source_file"), "raw", "reason")


@register("a3_read_emoji_dictionary")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.contains("text", F.lit("!!")), " 64").otherwise("")
    number = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("1F600 ; fully-qualified # "), "lang", F.lit("-"), "source", F.lit(" entry # "), "source", F.lit("/"),
        "lang", F.lit(" entry of "), number, mark,
    )
    line = (
        F.when(F.contains("text", F.lit("$$$")), F.concat(F.lit("# comment "), number))
        .when(F.contains("text", F.lit("%%%")), F.concat(F.lit("0023 ; x # "), "lang", F.lit(" not used")))
        .when(F.contains("text", F.lit("&&&")), "")
        .otherwise(entry)
    )
    path = scratch_path(spark, "dictionary")
    rel.table(spark, sf_dir, "documents").orderBy("doc_id").select(line.alias("value")).write.text(path)
    return tables.read_emoji_dictionary(spark, path)


@register("a4_write_prepared")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "prepared")
    rows = emoji.emoji_label(rel.tweets(spark, sf_dir), rel.dictionary(spark)).where(F.col("class").isNotNull())
    tables.write_prepared(rows.select("doc_id", "pos", "lang", "class", "count"), path, max_records=1000)
    return spark.read.parquet(path).select("doc_id", "pos", "lang", "class", "count")


def _incremental(spark: SparkSession, sf_dir: str, scope: str = "file") -> tuple[str, str]:
    """Prepare an archive in several batches, then again after more files have come."""
    source = rel.archive(spark, sf_dir, late=False)
    target, refused, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("out", "refused", "log"))
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    for late in (False, True):
        if late:
            rel.archive(spark, sf_dir, late=True, path=source)
        prepare_incremental(
            spark, f"{source}/*", target, checkpoint, rel.dictionary(spark), model, files_per_batch=120, refused=refused,
            scope=scope,
        )
    return target, refused


@register("a5_prepare_incremental")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = _incremental(spark, sf_dir)
    return spark.read.parquet(target).select("text", "lang", F.round("prob", 5).alias("prob"), "class", "count")


@register("a5_prepare_incremental_all_files")
def a5_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = _incremental(spark, sf_dir, "all")
    return spark.read.parquet(target).select("text", "lang", F.round("prob", 5).alias("prob"), "class", "count")


@register("a5_refused_records")
def a5_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refused = _incremental(spark, sf_dir)
    bad = spark.read.parquet(refused)
    return bad.select(rel.source_of(F.col("source_file")).alias("source_file"), "raw", "reason")


@register("a6_read_training")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_training(spark, f"{sf_dir}/documents.parquet", "en", text="text", target="n_chars")


def _line_file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "lines")
    rows = rel.document_lines(spark, sf_dir).orderBy("doc_id", "pos")
    rows.select(F.col("line").alias("value")).write.text(path)
    return path


@register("a7_read_lines")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_lines(spark, _line_file(spark, sf_dir))


@register("a7_read_lines_first")
def a7_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_lines(spark, _line_file(spark, sf_dir), n=500)


@register("a8_read_token_table")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-table")
    rel.token_table(spark, sf_dir).write.parquet(path)
    table, dim = tables.read_token_table(spark, path)
    return table.select("token", "idx", *vector_columns(dim=dim))


def _bucketed_tokens(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "bucketed-tokens")
    name = "tokens_" + path[-32:]
    tables.write_token_table(rel.token_table(spark, sf_dir), name, path, buckets, by)
    return tables.read_bucketed_tokens(spark, name)[0]


@register("a8_bucketed_token_table")
def a8_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _bucketed_tokens(spark, sf_dir, "token").select("token", "idx")
    words = _words(spark, sf_dir).select(F.col("word").alias("token"))
    found = lookup(words, table, "token", "left", max_bytes=0, bucketed=True)
    return found.groupBy("token", "idx").agg(F.count("*").alias("n"))


@register("a8_bucketed_id_table")
def a8_bucketed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _bucketed_tokens(spark, sf_dir, "idx")
    labels = rel.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("idx"), "vec_id")
    found = lookup(labels, table, "idx", "left", max_bytes=0, bucketed=True)
    return found.select("vec_id", "idx", "token", *vector_columns())


# Text cleaning


def _on(name: str, table: str, keys: list[str], column: str, op: Callable[[Column], Column], out: str = "cleaned"):
    @register(name)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = rel.tweets(spark, sf_dir) if table == "tweets" else rel.table(spark, sf_dir, table)
        return source.select(*keys, op(F.col(column)).alias(out))

    return query


_on("b1_remove_control_chars", "documents", ["doc_id"], "text", clean.remove_control_chars)
_on("b2_remove_links", "tweets", ["doc_id", "pos"], "text", clean.remove_links)
_on("b2_remove_links_url", "pages", ["page_id"], "url", clean.remove_links)
_on("b3_remove_tags", "tweets", ["doc_id", "pos"], "text", clean.remove_tags)
_on("b4_space_punctuation", "documents", ["doc_id"], "text", clean.space_punctuation)
_on("b5_space_punctuation_keep", "pages", ["page_id"], "html", lambda c: clean.space_punctuation(c, remove=False))
_on(
    "b5_space_punctuation_keep_tweets", "tweets", ["doc_id", "pos"], "text",
    lambda c: clean.space_punctuation(c, remove=False, max_smile_len=2),
)
_on("b6_trim_string", "documents", ["doc_id"], "text", clean.trim_string)
_on("b7_remove_non_printed_chars", "pages", ["page_id"], "html", clean.remove_non_printed_chars)
_on("b8_process_text", "pages", ["page_id"], "html", clean.process_text)
_on("b9_process_text_dataset", "documents", ["doc_id"], "text", clean.process_text_dataset)
_on("b10_process_tweets", "tweets", ["doc_id", "pos"], "text", clean.process_tweets)
_on("b11_has_punctuation", "tweets", ["doc_id", "pos"], "text", clean.has_punctuation, "found")
_on("b12_str_contains", "documents", ["doc_id"], "text", lambda c: clean.str_contains("token", c), "found")


@register("b13_remove64_emojis")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = emoji.remove64_emojis(rel.tweets(spark, sf_dir), rel.dictionary(spark))
    return rest.select("doc_id", "pos", "rest")


# Emojis


@register("c1_emoji_counts")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = emoji.emoji_counts(rel.tweets(spark, sf_dir), rel.dictionary(spark))
    return counts.select("doc_id", "pos", "emoji", "n")


@register("c2_emoji_counts_detailed")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = emoji.emoji_counts_detailed(rel.tweets(spark, sf_dir), rel.dictionary(spark))
    return counts.select("doc_id", "pos", "emoji", "is_64", "n")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.tweets(spark, sf_dir).select(
        "doc_id", "pos", "lang", "source_file", F.explode(F.array(clean.process_tweets(F.col("text")))).alias("text")
    )


@register("c3_emoji_filter")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = emoji.emoji_filter(_cleaned(spark, sf_dir), rel.dictionary(spark))
    return out.select("doc_id", "pos", F.coalesce("reject_reason", F.lit("kept")).alias("verdict"))


@register("c3_emoji_filter_loose")
def c3_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = emoji.FilterConfig(min_len=60, only_one_type=False, exclude_non64=False, only_one64_block=True)
    out = emoji.emoji_filter(_cleaned(spark, sf_dir), rel.dictionary(spark), config)
    return out.select("doc_id", "pos", F.coalesce("reject_reason", F.lit("kept")).alias("verdict"))


@register("c4_emoji_single_block")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = emoji.emoji_label(_cleaned(spark, sf_dir), rel.dictionary(spark)).where(F.col("class").isNotNull())
    return labelled.select(
        "doc_id", "pos", "class", emoji.emoji_single_block(F.col("text"), F.col("class")).alias("single")
    )


@register("c5_emoji_label")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = emoji.emoji_label(_cleaned(spark, sf_dir), rel.dictionary(spark)).where(F.col("class").isNotNull())
    return labelled.select("doc_id", "pos", "class", "count")


# Duplicates and sets


@register("d1_dedup_file")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_cleaned(spark, sf_dir).select("source_file", "text"))


@register("d1_dedup_all")
def d1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_cleaned(spark, sf_dir).select("source_file", "text"), scope="all")


@register("d2_combine_batches")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "conversations", "benchmark")
    return dedup.combine_batches(
        [rel.table(spark, sf_dir, name).select(F.lit(name).alias("origin"), "text") for name in names]
    )


@register("d3_emojis_non64")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = vocabulary.token_counts(rel.document_words(spark, sf_dir))
    entries = counts.select(F.col("token").alias("emoji"), (F.col("n") > 2).alias("is_64"))
    return emoji.emojis_non64(entries)


@register("labelled_tweets")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_tweets(rel.tweets(spark, sf_dir), rel.dictionary(spark))


# Language


@register("e1_language_profiles")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_profiles(rel.table(spark, sf_dir, "documents"))


@register("e2_language_predict")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    out = language.language_predict(rel.table(spark, sf_dir, "conversations"), model)
    return out.select("conv_id", "turn", "lang", F.round("prob", 5).alias("prob"))


@register("e3_language_no_answer")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    lines = rel.document_lines(spark, sf_dir).drop("lang")
    out = language.language_predict(lines, model, "line")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 4).alias("prob"))


@register("prepared_tweets")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    rows = prepare(rel.tweets(spark, sf_dir), rel.dictionary(spark), model)
    return rows.withColumn("prob", F.round("prob", 5))


# Training frame and splits


@register("f0_assemble_training")
def f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = emoji.emoji_verdict(_cleaned(spark, sf_dir), rel.dictionary(spark))
    kept = verdict.where(F.col("reject_reason").isNull())
    return splits.assemble_training(kept, rel.label_map(spark))


@register("f0_prepared_to_features")
def f0_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the preparation to features: rows of one text in several files stay apart."""
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    rows = prepare(rel.tweets(spark, sf_dir), rel.dictionary(spark), model, with_source=True)
    frame = durable(splits.assemble_training(rows, rel.label_map(spark)), "frame")
    features = text_features(frame, ["row_id", "target"], rel.token_table(spark, sf_dir), DIM, FeatureConfig("bag", "mean", 30))
    return features.groupBy("row_id", "target").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))


@register("f1_holdout_split")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.holdout_split(rows, "doc_id")


@register("f1_holdout_split_groups")
def f1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splits.holdout_split(rows, "doc_id", group="text").select("doc_id", "is_val")


@register("f2_split_mode")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = splits.holdout_split(rel.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1)
    return splits.split_mode(sides, "val")


@register("f3_shuffle_rows")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    shuffled = splits.shuffle_rows(rows, "doc_id", epoch=1).withColumn("_place", F.monotonically_increasing_id())
    return with_ordinal(durable(shuffled, "shuffled"), [F.col("_place")], "position").drop("_place")


@register("f4_assign_batches")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return splits.assign_batches(rows, 64, [F.col("conv_id"), F.col("turn")])


@register("f4_assign_batches_shuffled")
def f4_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.table(spark, sf_dir, "documents").select("doc_id")
    return splits.assign_batches(rows, BATCH, [splits.shuffle_key(F.col("doc_id"), splits.SEED, 0)])


# Tokens and vectors


@register("g1_plain_text_split")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tok.plain_text_split(F.col("text"))
    return rel.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n"), digest(words).alias("tokens")
    )


@register("g2_char_split")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = tok.char_split(F.col("text"))
    return rel.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(chars).alias("n"), digest(chars).alias("tokens")
    )


@register("g3_find_ngrams")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = tok.find_ngrams(F.col("text"), 3)
    return rel.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(grams).alias("n"), digest(grams).alias("grams")
    )


@register("g4_word_ngrams")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # N-grams are cut once per distinct word.
    words = vocabulary.token_counts(rel.document_words(spark, sf_dir))
    grams = words.select("n", tok.exploded(tok.word_ngrams(F.col("token"))).alias("token"))
    return grams.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))


@register("g5_build_vocabulary")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(rel.document_words(spark, sf_dir), min_count=2)


@register("g5_frequent_vocabulary")
def g5_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(rel.document_words(spark, sf_dir), min_count=2, size=FREQUENT, tracked=50_000)


@register("g6_encode_ids")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = rel.document_words(spark, sf_dir)
    table = durable(vocabulary.build_vocabulary(words), "vocabulary")
    encoded = vocabulary.encode_ids(words, table, ["doc_id"], oov="unk", counted=True)
    return encoded.select("doc_id", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids"))


@register("g7_pad_sequence")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.transform(F.split("text", "\n"), lambda line: F.length(line))
    return rel.table(spark, sf_dir, "documents").select(
        "doc_id",
        tok.sequence_length(codes, 20).alias("seq_len"),
        digest(tok.pad_sequence(codes, 20)).alias("ids"),
    )


@register("g8_pad_words")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = word_samples(rel.table(spark, sf_dir, "documents"), ["doc_id"], "text", MAX_LEN)
    return samples.select("doc_id", "seq_len", digest(F.col("words")).alias("words"))


def _subword_model() -> bytes:
    """A public subword model; its path is a parameter of the job."""
    path = os.environ.get("SUBWORD_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.document_words(spark, sf_dir).select("doc_id", tok.exploded(F.col("tokens"), with_position=True).alias("pos", "word"))


@register("g9_ngram_lookup")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.ngram_lookup(_words(spark, sf_dir), rel.token_table(spark, sf_dir))
    return found.select("word", "known", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids"))


@register("g10_unknown_words")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.unknown_words(_words(spark, sf_dir), rel.token_table(spark, sf_dir))


@register("g11_word_vectors_mean")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings.word_vectors_mean(_words(spark, sf_dir), rel.token_table(spark, sf_dir), DIM)
    return vectors.select("word", *vector_columns())


@register("g12_word_vectors_attention")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings.word_vectors_attention(
        _words(spark, sf_dir), rel.token_table(spark, sf_dir), HEADS[0], DIM
    )
    return vectors.select("word", *vector_columns())


def _conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rel.token_table(spark, sf_dir)
    words = rel.conversation_words(spark, sf_dir)
    # What the padding would cut off is not encoded.
    cut = words.withColumn("tokens", F.slice("tokens", 1, MAX_LEN))
    encoded = vocabulary.encode_ids(cut, table, ["conv_id", "turn", "role"], oov="unk")
    padded = encoded.select(
        "conv_id", "turn", "role",
        tok.pad_sequence(F.col("ids"), MAX_LEN, F.lit(0).cast("bigint")).alias("ids"),
        tok.sequence_length(F.col("ids"), MAX_LEN).alias("seq_len"),
    )
    return embeddings.embedding_lookup(vocabulary.sequence_steps(padded, "ids", "idx"), table)


@register("g13_embedding_lookup")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_steps(spark, sf_dir).select("conv_id", "turn", "pos", *vector_columns())


@register("g13_subword_ids")
def g13_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _subword_model()
    documents = rel.table(spark, sf_dir, "documents")
    # Each text is encoded once, and texts and ids meet by their digests; neither is shuffled.
    encoded = documents.select("doc_id", F.sha2("text", 256).alias("_text"), subwords.subword_ids(F.col("text"), model).alias("_all"))
    samples = subwords.subword_samples(encoded, ["doc_id", "_text", "_all"], model, max_len=MAX_LEN, encoded="_all")
    back = F.sha2(subwords.subword_text(F.col("_all"), model), 256)
    rows = durable(
        samples.select(
            "doc_id", "_text", F.size("_all").alias("n"), digest(F.col("_all")).alias("all_ids"), back.alias("_back"),
            "seq_len", digest(F.col("ids")).alias("ids"),
        ),
        "subwords",
    )
    whole = rows.select("doc_id", "n", "all_ids", "_back").join(rows.select("doc_id", "_text"), "doc_id").select(
        "doc_id", "n", "all_ids", (F.col("_back") == F.col("_text")).alias("round_trip")
    )
    return whole.join(rows.select("doc_id", "seq_len", "ids"), "doc_id")


@register("g14_category_embedding")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = embeddings.category_width(CLASSES)

    def folded(i: int, step: int) -> Column:
        """Every ``step``-th number of the vector from ``i`` on, summed; so all of them are used."""
        return sum((F.get("embedding", F.lit(j)).cast("double") for j in range(i, DIM, step)), F.lit(0.0))

    vectors = rel.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("code")).agg(
        F.array(*[F.avg(folded(i, width)) for i in range(width)]).alias("vector")
    )
    table = durable(vectors, "category")
    words = rel.conversation_words(spark, sf_dir).select(
        "conv_id", "turn", tok.exploded(F.col("tokens"), with_position=True).alias("pos", "word")
    )
    steps = words.select(
        "conv_id", "turn", "pos",
        (F.length("word") % CLASSES).alias("size_code"), (F.col("pos") % CLASSES).alias("place_code"),
        F.array(F.length("word").cast("double")).alias("vector"),
    )
    out = embeddings.category_embedding(steps, {"size_code": (table, CLASSES), "place_code": (table, CLASSES)})
    return out.select("conv_id", "turn", "pos", *vector_columns(dim=1 + 2 * width))


# Pooling


@register("h1_pool_mean")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pool_mean(_conversation_steps(spark, sf_dir), ["conv_id", "turn"], DIM).select(
        "conv_id", "turn", *vector_columns()
    )


@register("h2_pool_max")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pool_max(_conversation_steps(spark, sf_dir), ["conv_id", "turn"], DIM).select(
        "conv_id", "turn", *vector_columns()
    )


@register("h3_pool_attention")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_attention(_conversation_steps(spark, sf_dir), ["conv_id", "turn"], HEADS[0], DIM)
    return pooled.select("conv_id", "turn", *vector_columns())


@register("h3_pool_attention_empty")
def h3_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _conversation_steps(spark, sf_dir).withColumn("seq_len", F.when(F.col("turn") == 0, 0).otherwise(F.col("seq_len")))
    keyed = steps.withColumn("conv_id", F.nullif(F.concat(F.lit("c"), "conv_id"), F.lit("c1")))
    pooled = pooling.pool_attention(keyed, ["conv_id", "turn"], HEADS[0], DIM, "relu")
    return pooled.select("conv_id", "turn", *vector_columns())


def _wide_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.flatten(F.array_repeat("vector", WIDE))
    return _conversation_steps(spark, sf_dir).withColumn("vector", wide)


@register("h1_pool_mean_wide")
def h1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_mean(_wide_steps(spark, sf_dir), ["conv_id", "turn"], WIDE * DIM)
    return pooled.select("conv_id", "turn", *vector_columns(dim=WIDE * DIM))


@register("h2_pool_max_wide")
def h2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_max(_wide_steps(spark, sf_dir), ["conv_id", "turn"], WIDE * DIM)
    return pooled.select("conv_id", "turn", *vector_columns(dim=WIDE * DIM))


@register("h3_pool_attention_wide")
def h3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_attention(_wide_steps(spark, sf_dir), ["conv_id", "turn"], HEADS[0] * WIDE, WIDE * DIM)
    return pooled.select("conv_id", "turn", *vector_columns(dim=WIDE * DIM))


@register("h3_pool_attention_relu")
def h3_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_attention(_conversation_steps(spark, sf_dir), ["conv_id", "turn"], HEADS[0], DIM, "relu")
    return pooled.select("conv_id", "turn", *vector_columns())


@register("h4_pool_attention_multi")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_attention_multi(_conversation_steps(spark, sf_dir), ["conv_id", "turn"], HEADS, DIM)
    return pooled.select("conv_id", "turn", "head", *vector_columns())


@register("text_features")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = FeatureConfig("wbag", "attention", MAX_LEN, tuple(HEADS[0]), tuple(HEADS[1]))
    documents = rel.table(spark, sf_dir, "documents")
    cleaned = documents.select("doc_id", clean.process_text_dataset(F.col("text")).alias("processed"))
    out = text_features(cleaned, ["doc_id"], rel.token_table(spark, sf_dir), DIM, config)
    return out.select("doc_id", *vector_columns())


# Classifier


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("target")
    )


def _entropy(counts: DataFrame) -> Column:
    """Entropy of the classes from their counts ``n`` in a group: what a constant answer loses."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*[c for c in counts.columns if c not in ("target", "n")]))
    return -share * F.log(share)


@register("i1_classifier_fit")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_vectors(spark, sf_dir)
    _, metrics = train_and_evaluate(rows, "vec_id", DIM, classifier.MLP_SIZES, max_iter=40)
    counts = rows.groupBy("target").agg(F.count("*").alias("n"))
    entropy = counts.select(_entropy(counts).alias("e")).agg(F.sum("e")).first()[0]
    return metrics.select("loop", "n", ((F.col("loop") != "Train") | (F.col("loss") < entropy)).alias("learns"))


def _two_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_attention_multi(_conversation_steps(spark, sf_dir), ["conv_id", "turn", "role"], HEADS[:2], DIM)
    return durable(pooled.withColumn("target", (F.col("role") == "assistant").cast("int")), "two-heads")


@register("i2_classifier_fit_multi_head")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_heads(spark, sf_dir)
    model = classifier.classifier_fit_multi_head(rows, 2, max_iter=20)
    out = classifier.classifier_predict_multi_head(model, rows, ["conv_id", "turn", "target"])
    own = out.select("target", F.posexplode("logits").alias("head", "logit"))
    right = (F.col("target") == F.col("head")).cast("double")
    loss = F.log1p(F.exp(-F.abs("logit"))) + F.greatest("logit", F.lit(0.0)) - right * F.col("logit")
    share = F.avg(right)
    return own.groupBy("head").agg(
        F.count("*").alias("n"), F.round(share, 6).alias("share"),
        (F.avg(loss) <= -share * F.log(share) - (1 - share) * F.log(1 - share) + 1e-3).alias("learns"),
    )


@register("i2_predict_given_weights")
def i2_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = classifier.MultiHeadModel(tuple(map(tuple, HEADS[1:])), (0.1, -0.2))
    out = classifier.classifier_predict_multi_head(model, _two_heads(spark, sf_dir), ["conv_id", "turn"])
    logits = [F.round(F.get("logits", F.lit(h)), 5).alias(f"logit_{h}") for h in range(2)]
    return out.select("conv_id", "turn", *logits, "prediction")


@register("i3_classifier_predict")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_vectors(spark, sf_dir)
    model = classifier.classifier_fit(rows, DIM, (CLASSES,), max_iter=20)
    scored = classifier.classifier_predict(model, rows)
    return scored.select(
        "vec_id", "target", F.size("logits").cast("long").alias("n_logits"),
        (F.get("logits", F.col("prediction")) == F.array_max("logits")).alias("is_best"),
    )


@register("i3_predict_given_weights")
def i3_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = classifier.classifier_of_weights(spark, (DIM, CLASSES), GIVEN)
    scored = classifier.classifier_predict(model, _labelled_vectors(spark, sf_dir))
    return scored.select(
        "vec_id", F.round(F.get("logits", F.lit(0)), 5).alias("logit_first"),
        F.round(F.get("logits", F.lit(CLASSES - 1)), 5).alias("logit_last"), "prediction",
    )


def _layered(weights: list[list[float]]) -> training_rounds.HeadNetwork:
    """Two hidden units and one answer per head: the units see the given weights once as they are, once turned round."""
    hidden = np.array([[[x, -2 * x] for x in head] for head in weights])
    bias = np.array([[[0.05, 0.3]]] * len(weights))
    last, end = np.array([[[1.5], [-0.5]]] * len(weights)), np.array([[[0.1 * h]] for h in range(len(weights))])
    flat = np.concatenate([x.ravel() for x in (hidden, bias, last, end)])
    return training_rounds.HeadNetwork(len(weights), (DIM, 2, 1), flat)


@register("i2_layers_given_weights")
def i2_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rounds.side_by_side(_two_heads(spark, sf_dir), ["conv_id", "turn"], 2)
    out = training_rounds.network_predict(_layered(HEADS[1:]), rows)
    logits = [F.round(F.get("logits", F.lit(h)), 5).alias(f"logit_{h}") for h in range(2)]
    return out.select("conv_id", "turn", *logits, "prediction")


@register("i2_layers_fit")
def i2_layers_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _two_heads(spark, sf_dir)
    rows = training_rounds.side_by_side(heads, ["conv_id", "turn", "target"], 2).withColumn("is_val", F.lit(False))
    history = training_rounds.fit_epochs(rows, 2, (DIM, 8, 1), scratch_path(spark, "history"), epochs=2, rounds=10)
    out = training_rounds.network_predict(history.network(1), rows)
    scored = evaluation.batch_metrics(out, ["is_val"])
    before, after = (history.read(e).metrics[0].loss for e in (0, 1))
    return scored.select("n", (F.lit(after) < F.lit(before)).alias("learns"), (F.abs(F.col("loss") - after) < 1e-9).alias("agrees"))


@register("train_history")
def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs, stopped after the first and taken up again: rows per epoch and side, and one best epoch."""
    rows = _labelled_vectors(spark, sf_dir).select("vec_id", F.array("vector").alias("vectors"), "target")
    sides = splits.holdout_split(rows, "vec_id")
    path = scratch_path(spark, "history")
    training_rounds.fit_epochs(sides, 1, (DIM, 32, CLASSES), path, epochs=1)
    table = training_rounds.fit_epochs(sides, 1, (DIM, 32, CLASSES), path, epochs=3).table()
    least = F.min(F.when(F.col("loop") == "Val", F.col("loss"))).over(Window.partitionBy())
    first = F.min(F.when(F.col("epoch") == 0, F.col("loss"))).over(Window.partitionBy("loop"))
    best = F.max(F.when((F.col("loop") == "Val") & F.col("is_best"), F.col("loss"))).over(Window.partitionBy())
    return table.select(
        "epoch", "loop", "n", (best == least).alias("best_is_least"),
        ((F.col("loop") == "Val") | (F.col("epoch") == 0) | (F.col("loss") < first)).alias("learns"),
    )


@register("train_tweets")
def train_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tweets to a fitted and evaluated classifier: rows and classes of each side."""
    model = language.language_fit(rel.table(spark, sf_dir, "documents"))
    labelled = durable(labelled_tweets(rel.tweets(spark, sf_dir), rel.dictionary(spark)), "labelled")
    frame = splits.assemble_training(language.language_predict(labelled, model), rel.label_map(spark))
    english = durable(frame.where(F.col("lang") == "en").drop("lang"), "english")
    config = FeatureConfig("bag", "mean", 30)
    features = text_features(english, ["row_id", "target"], rel.token_table(spark, sf_dir), DIM, config)
    kept = durable(features, "features")
    fitted, metrics = train_and_evaluate(kept, "row_id", DIM, (len(rel.LABEL_MAP),), max_iter=20, written=True)
    loop = F.when(F.col("is_val"), "Val").otherwise("Train").alias("loop")
    sides = splits.holdout_split(kept, "row_id").groupBy(loop).agg(
        *[F.count_if(F.col("target") == t).alias(f"class_{t}") for _, t in rel.LABEL_MAP]
    )
    return metrics.join(sides, "loop").select(
        "loop", "n", *[f"class_{t}" for _, t in rel.LABEL_MAP], (F.col("loss") > 0).alias("has_loss")
    )


# Evaluation


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target")
    )


@register("j1_cross_entropy")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cross_entropy(_logits(spark, sf_dir)).select(F.round("loss", 6).alias("loss"), "n")


@register("j2_topk_accuracy")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.topk_accuracy(_logits(spark, sf_dir))
    return out.select(F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"))


@register("j3_weighted_average")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.weighted_average(rel.metrics(spark, sf_dir), ["run", "epoch", "loop"])
    return out.select(
        "run", "epoch", "loop", "last", F.round("sum", 4).alias("sum"), "count", rounded("avg")
    )


@register("j4_running_average")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.running_average(rel.metrics(spark, sf_dir), ["run", "loop"])
    return out.select("run", "loop", "batch", rounded("avg"))


@register("j4_running_average_null_groups")
def j4_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.metrics(spark, sf_dir).withColumns({
        "run": F.nullif(F.concat(F.lit("r"), F.col("run") % 7), F.lit("r0")), "value": F.nullif("value", F.round("value", 0)),
    })
    out = evaluation.running_average(rows, ["run", "loop"])
    return out.select("run", "loop", "batch", rounded("avg"))


def _streamed_average(spark: SparkSession, sf_dir: str, order: tuple[int, ...]) -> str:
    """The metrics arrive in thirds of the range of ``batch``, in the given order; returns the target."""
    source, target, checkpoint = (scratch_path(spark, x) for x in ("metrics", "averages", "stream"))
    rows = durable(rel.metrics(spark, sf_dir), "metrics-rows")
    ends = rows.agg(F.min("batch").alias("low"), F.max("batch").alias("high")).first()
    third = F.floor(3 * (F.col("batch") - ends.low) / (ends.high - ends.low + 1))
    for part in order:
        rows.where(third == part).write.mode("append").parquet(source)
        running_average_stream(spark, source, target, checkpoint, ["run", "loop"], files_per_batch=10_000)
    return target


@register("j4_running_average_stream")
def j4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _streamed_average(spark, sf_dir, (0, 1, 2))
    return spark.read.parquet(f"{target}/rows/*").select("run", "loop", F.col("batch").alias("at"), rounded("avg"))


@register("j4_running_average_late")
def j4_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _streamed_average(spark, sf_dir, (1, 0, 2))
    both = spark.read.parquet(f"{target}/rows/*").unionByName(spark.read.parquet(f"{target}/late/*"), allowMissingColumns=True)
    return both.select("run", "loop", F.col("batch").alias("at"), F.isnull("avg").alias("late"), rounded("avg"))


@register("j6_best_epochs_null_groups")
def j6_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.metrics(spark, sf_dir).select(
        F.nullif(F.concat(F.lit("r"), F.col("run") % 7), F.lit("r0")).alias("run"), F.col("batch").alias("epoch"), F.col("value").alias("val_loss")
    )
    return evaluation.best_epochs(rows, ["run"])


@register("j5_epoch_summary")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.metrics(spark, sf_dir).select(
        "run", "epoch", "loop", "n", F.col("value").alias("loss"),
        F.col("n").cast("double").alias("top1"), F.least(F.col("n") * 1.5, F.lit(100.0)).alias("top3"),
    )
    out = evaluation.epoch_summary(rows, ["run", "epoch"])
    names = [f"{loop}_{m}" for loop in ("train", "val") for m in ("loss", "top1", "top3")]
    return out.select("run", "epoch", *map(rounded, names))


@register("j6_best_epochs")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.metrics(spark, sf_dir).select("run", F.col("batch").alias("epoch"), F.col("value").alias("val_loss"))
    return evaluation.best_epochs(rows, ["run"])
