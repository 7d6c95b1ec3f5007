"""Language of a text from character n-grams: a model table over all grams, and its answers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from moodmill.functions.grams import MAX_SIZE, GramWeights, counted_cuts
from moodmill.functions.tokens import exploded, find_ngrams
from moodmill.functions.vectors import per_dimension
from moodmill.operators.lookup import BROADCAST_BYTES, lookup
from moodmill.session import durable

GRAM_SIZES = (1, 2, 3)
TOP_GRAMS = 400  # of a profile; the fitted model holds all grams
_SALTS = 32
_CHUNK = 32
_KNOWN = "\x00"  # no language code


@dataclass(frozen=True)
class LanguageModel:
    """A multinomial model with add-one smoothing over all grams.

    ``weights`` holds per gram the languages in which it occurs and the logarithm of its
    count plus one. Per language, ``priors`` is the logarithm of its share of the texts
    and ``defaults`` that of the weight of a gram it never has.
    """

    weights: DataFrame
    languages: tuple[str, ...]
    priors: tuple[float, ...]
    defaults: tuple[float, ...]
    sizes: tuple[int, ...]

    @cached_property
    def array_bytes(self) -> int:
        """Size of the weights as arrays of sums, a row per gram."""
        return self.weights.count() * (len(self.languages) + 1) * 8

    @cached_property
    def arrays(self) -> GramWeights:
        """The weights in arrays, languages in the order of their codes; the driver holds them."""
        used = self.weights.where(F.length("gram").isin(*self.sizes)).select("gram", "held.lang", "held.w").toArrow().combine_chunks()
        langs, weights = (pa.concat_arrays(used.column(c).chunks) if used.num_rows else None for c in ("lang", "w"))
        if langs is None:
            empty = np.zeros(0, np.int64)
            return GramWeights(pa.array([], pa.string()), empty, empty, np.zeros(0), len(self.languages))
        rows = np.repeat(np.arange(used.num_rows), np.asarray(pc.list_value_length(langs)))
        columns = np.asarray(pc.index_in(langs.flatten(), pa.array(sorted(self.languages), langs.type.value_type)).fill_null(-1))
        known = columns >= 0
        grams = pa.concat_arrays(used.column("gram").chunks)
        return GramWeights(grams, rows[known], columns[known], np.asarray(weights.flatten())[known], len(self.languages))


def char_grams(text: Column, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """All character n-grams of the given sizes."""
    return F.concat(*[find_ngrams(text, n) for n in sizes])


def _cuts(text: Column, sizes: tuple[int, ...]) -> Column:
    """The longest gram at each position, shorter at the end of the text: all shorter ones are its prefixes."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{max(sizes)}}}))."), F.lit(1))


def _prefixes(cuts: DataFrame, sizes: tuple[int, ...], *keep: str) -> DataFrame:
    """The grams of the cuts, a row each."""
    sized = cuts.where(F.col("cut").isNotNull()).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return sized.where(F.length("cut") >= F.col("size")).select(
        *keep, F.substring(F.col("cut"), F.lit(1), F.col("size")).alias("gram")
    )


def gram_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = GRAM_SIZES
) -> DataFrame:
    """Occurrences of each gram per language: ``lang, gram, n``. The text is cut once.

    Grams of up to ``MAX_SIZE`` code points are counted in Arrow batches, before they become rows.
    """
    longest, texts = max(sizes), df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    if longest <= MAX_SIZE:
        kind = texts.schema["lang"].dataType
        schema = T.StructType([T.StructField("lang", kind), T.StructField("cut", T.StringType()), T.StructField("n", T.LongType())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return counted_cuts(batches, longest)

        cuts = texts.where(F.col("text").isNotNull()).mapInArrow(count, schema)
        counted = cuts.groupBy("lang", "cut").agg(F.sum("n").alias("n"))
    else:
        cuts = texts.select("lang", exploded(_cuts(F.col("text"), sizes)).alias("cut"))
        counted = cuts.where(F.col("cut").isNotNull()).groupBy("lang", "cut").agg(F.count("*").alias("n"))
    return _prefixes(counted, sizes, "lang", "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _leaders(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` grams of each language: ``lang, gram, n, rank``.

    Ranked twice: first within hash parts of a language, so that one task never
    sorts all grams of a frequent language, then among the leaders of the parts.
    """
    order = [F.desc("n"), F.asc("gram")]
    parts = counts.withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    within = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    best = parts.withColumn("_rank", within).where(F.col("_rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", "gram", "n", "rank")


def language_profiles(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sizes: tuple[int, ...] = GRAM_SIZES,
    top: int = TOP_GRAMS,
) -> DataFrame:
    """The ``top`` most frequent grams per language: ``lang, gram, n, rank``."""
    return _leaders(gram_counts(df, text, lang, sizes), top)


def language_fit(
    df: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = GRAM_SIZES
) -> LanguageModel:
    """Fit the model over all grams of the labelled texts, which are read once to count them.

    The driver sees one row per language. Rows without text or language take no part.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    texts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("texts"))
    counts = durable(gram_counts(labelled, text, lang, sizes), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = sorted(texts.join(totals, "lang", "left").fillna(0, ["total"]).collect())
    all_texts = sum(r.texts for r in rows)
    held = F.array_sort(F.collect_list(F.struct("lang", F.log(F.col("n") + 1.0).alias("w"))))
    weights = durable(counts.groupBy("gram").agg(held.alias("held")), "language-model")
    grams = weights.count()
    return LanguageModel(
        weights,
        tuple(r.lang for r in rows),
        tuple(math.log((r.texts + 1) / (all_texts + len(rows))) for r in rows),
        tuple(-math.log(max(1, r.total + grams)) for r in rows),
        tuple(sizes),
    )


def language_predict(df: DataFrame, model: LanguageModel, text: str = "text", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``lang, prob``: the most probable language, ``'none'`` and 0 for a text without any gram of the model.

    A model whose sums fit into ``max_bytes`` goes to the tasks as arrays, and texts are weighed in
    Arrow batches where they are. With a larger one the cuts of the texts meet it in joins. Both give the same
    answers; ties go to the lowest language code.
    """
    if model.array_bytes > max_bytes:
        return _predicted_by_joins(df, model, text)
    answer = F.col("_answer")
    return df.select("*", _answers(F.col(text), model).alias("_answer")).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(answer["lang"], F.lit("none")).alias("lang"),
        F.coalesce(answer["prob"], F.lit(0.0)).alias("prob"),
    )


def _answers(text: Column, model: LanguageModel) -> Column:
    """Language and probability of each text, nulls if it has no gram of the model."""
    arrays, order = model.arrays, sorted(range(len(model.languages)), key=lambda i: model.languages[i])
    names = pa.array([model.languages[i] for i in order], pa.string())
    priors, defaults = (np.array([x[i] for i in order])[:, None] for x in (model.priors, model.defaults))

    @F.arrow_udf("struct<lang:string,prob:double>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = arrays.reader()
        for texts in batches:
            sums = read(texts)
            none = sums[0] == 0
            if not len(names):
                yield pa.nulls(len(texts), pa.struct([("lang", pa.string()), ("prob", pa.float64())]))
                continue
            scores = priors + defaults * sums[0] + sums[1:]
            best = scores.argmax(axis=0)
            rest = np.exp(scores - scores.max(axis=0)).sum(axis=0)
            lang = names.take(pa.array(best, mask=none))
            yield pa.StructArray.from_arrays([lang, pa.array(1 / rest, mask=none)], ["lang", "prob"])

    return answer(text)


def _predicted_by_joins(df: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """The answers of a model of any size.

    Texts are cut at each position. For each distinct cut the weights of its grams are
    added up once; the cuts of the texts then meet that table, which ``lookup``
    broadcasts if it is small. Partial sums leave a row per text before the shuffle.
    """
    # Two hashes stand for a text, so that long texts are not dragged through the joins.
    key = [F.xxhash64(F.col(text)).alias("_h"), F.xxhash64(F.lit(1), F.col(text)).alias("_i")]
    asked = df.select(F.col(text).alias("_asked"), *key).where(F.col("_asked").isNotNull()).distinct()
    cuts = asked.select("_h", "_i", exploded(_cuts(F.col("_asked"), model.sizes)).alias("cut"))
    cuts = cuts.where(F.col("cut").isNotNull())

    known = lookup(
        _prefixes(cuts.select("cut").distinct().withColumn("_cut", F.col("cut")), model.sizes, "_cut"),
        model.weights, "gram", "inner",
    )
    # One more entry counts the known grams.
    entries = F.concat(F.array(F.struct(F.lit(_KNOWN).alias("lang"), F.lit(1.0).alias("w"))), F.col("held"))
    added = known.select("_cut", F.inline(entries)).groupBy("_cut", "lang").agg(F.sum("w").alias("w"))
    by_language = added.groupBy("_cut").agg(F.map_from_entries(F.collect_list(F.struct("lang", "w"))).alias("_held"))
    # A dense vector per cut: the number of known grams, then a sum per language; in chunks of bounded width.
    slots = F.from_json(F.lit(json.dumps([_KNOWN, *model.languages])), "array<string>")
    n_slots = len(model.languages) + 1
    width = min(n_slots, _CHUNK)
    n_chunks = -(-n_slots // width)
    dense = F.concat(
        F.transform(slots, lambda x: F.coalesce(F.try_element_at("_held", x), F.lit(0.0))),
        F.array_repeat(F.lit(0.0), n_chunks * width - n_slots),
    )
    chunks = F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda k: F.slice("_dense", k * width + 1, F.lit(width)))
    table = durable(
        by_language.withColumn("_dense", dense).select(F.col("_cut").alias("cut"), chunks.alias("_chunks")), "cut-weights"
    )

    met = lookup(cuts, table, "cut", "inner").select("_h", "_i", F.posexplode("_chunks").alias("_chunk", "_v"))
    sums = met.groupBy("_h", "_i", "_chunk").agg(per_dimension(F.sum, F.col("_v"), width).alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_chunk", "_v")))
    gathered = sums.groupBy("_h", "_i").agg(F.flatten(F.transform(ordered, lambda x: x["_v"])).alias("_sums"))
    listed = F.from_json(
        F.lit(json.dumps([{"l": a, "p": b, "d": c} for a, b, c in zip(model.languages, model.priors, model.defaults)])),
        "array<struct<l:string,p:double,d:double>>",
    )
    scores = F.transform(
        listed,
        lambda t, i: F.struct((t["p"] + t["d"] * F.get("_sums", F.lit(0)) + F.get("_sums", i + 1)).alias("s"), t["l"].alias("l")),
    )
    top = F.array_max(F.transform("_scores", lambda x: x["s"]))
    best = F.array_min(F.transform("_scores", lambda x: F.struct((-x["s"]).alias("s"), x["l"].alias("l"))))["l"]
    rest = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("_top")))
    answers = (
        gathered.withColumn("_scores", scores).withColumn("_top", top)
        .select(F.col("_h").alias("_ah"), F.col("_i").alias("_ai"), best.alias("_lang"), (1 / rest).alias("_prob"))
    )
    joined = df.select("*", *key).join(answers, (F.col("_h") == F.col("_ah")) & (F.col("_i") == F.col("_ai")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce("_lang", F.lit("none")).alias("lang"),
        F.coalesce("_prob", F.lit(0.0)).alias("prob"),
    )
