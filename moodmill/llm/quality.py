"""Quality rules whose cutoffs are certified on labelled rows.

Every document gets a few ratios in which more is worse. For each stratum (language)
and ratio, cutoffs are tested from the loosest to the tightest: the hypothesis that a
cutoff rejects more than the allowed share of good documents is refuted by an exact
binomial tail over the labelled good documents of the stratum. Testing in a fixed order
and stopping at the first failure needs no correction within a ratio; over all strata
and ratios the level is divided (Bonferroni). The allowed share of a stratum is divided
among its ratios, so that all rules together keep it. Among certified cutoffs the one
with the most bad documents net of good ones is taken, the loosest of equals; a stratum
with too few labels gets none and rejects nothing.

Only DataFrame functions are used. A text stays within its row: repeated windows are
found by sorting the hashes of the row's own windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from moodmill.llm.common import WHITESPACE, durable

FALSE_REJECTION = 0.02
LEVEL = 0.05
STEPS = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RATIOS = ("symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_shout", "n_lines", "n_dup_lines", "n_repeat_words")
_SERIES = 20_000


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of a text; null counts as empty.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines``, ``n_repeat_words`` and ``n_shout`` (capitals A-Z and exclamation
    marks). Other columns stay; names beginning with ``_q`` are used in between.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = df.withColumns({
        "_qw": F.array_remove(F.split(whole, WHITESPACE + "+"), ""),
        "_ql": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size("_qw")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_qw", i), F.get("_qw", i + 1), F.get("_qw", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = cut.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", "_qw")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_shout": F.length(F.regexp_replace(whole, r"[^A-Z!]+", "")).cast("long"),
        "n_lines": F.size("_ql").cast("long"),
        "n_dup_lines": (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long"),
        "_qg": windows,
    }).drop("_qw", "_ql")
    # Most texts repeat no window; only the others are sorted.
    sorted_ = hashed.withColumn(
        "_qs",
        F.when(
            F.size(F.array_distinct("_qg")) < F.size("_qg"),
            F.sort_array(F.arrays_zip(F.col("_qg").alias("h"), F.sequence(F.lit(0), F.size("_qg") - 1).alias("i"))),
        ),
    ).drop("_qg")
    size = F.size("_qs")
    twice = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda k: ((k > 0) & (F.get("_qs", k - 1)["h"] == F.get("_qs", k)["h"]))
        | ((k < size - 1) & (F.get("_qs", k + 1)["h"] == F.get("_qs", k)["h"])),
    )
    starts = sorted_.withColumn(
        "_qp", F.when(F.col("_qs").isNotNull(), F.transform(twice, lambda k: F.get("_qs", k)["i"]))
    ).drop("_qs")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_qp", lambda p: F.array(p, p + 1, p + 2)))))
    out = starts.withColumn(
        "n_repeat_words", F.when(F.col("_qp").isNotNull(), covered).otherwise(0).cast("long")
    ).drop("_qp")
    # A filter on the counts must not be pushed below, where it would count again: inline holds it back.
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*COUNTS))))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(0.0)


def with_ratios(counted: DataFrame) -> DataFrame:
    """Add the ratios of RATIOS, each between 0 and 1, to what ``text_counts`` gives."""
    return counted.withColumns({
        "symbol_ratio": _share("n_symbols", "n_words"),
        "shout_ratio": _share("n_shout", "word_chars"),
        "dup_line_ratio": _share("n_dup_lines", "n_lines"),
        "repeat_ratio": _share("n_repeat_words", "n_words"),
    })


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _ln_factorial(n: Column) -> Column:
    m = n + 8.0
    stirling = m * F.log(m) - m + 0.5 * F.log(m * (2 * math.pi)) + 1 / (12 * m) - 1 / (360 * m * m * m)
    return stirling - sum((F.log(n + float(i)) for i in range(1, 9)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), never too small; 1 where k is not below the mean.

    The terms below k are summed downwards as multiples of the term at k. After
    20,000 terms the rest is bounded by its geometric series.
    """
    k, n = k.cast("double"), n.cast("double")
    at_k = F.exp(
        _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(float(_SERIES))).cast("int")),
        start,
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1.0) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
    )
    ratio = k / (n - k + 1.0) * odds
    tail = at_k * (summed["sum"] + summed["term"] / (1.0 - ratio))
    return F.when((n > 0) & (k < n * p), F.least(F.lit(1.0), tail)).otherwise(1.0)


def certified_cutoffs(
    scored: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    stratum: str = "lang",
    quality: str = "quality",
    false_rejection: float = FALSE_REJECTION,
    level: float = LEVEL,
    steps: int = STEPS,
) -> DataFrame:
    """``stratum`` and one cutoff per ratio: a document is rejected if a ratio is greater.

    ``scored`` holds key, stratum and the ratios; ``labels`` key and quality 0/1. Only
    rows with a label count, a repeated label row counts once; if a key has both labels
    it counts as good. A ratio without a certified cutoff gets null. Null is a stratum.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(key).agg(F.max(quality).alias("_good"))
    rows = scored.select(key, stratum, *RATIOS).join(known, key)
    bucket = [F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * steps).cast("int").alias("bucket")) for r in RATIOS]
    # At most strata x ratios x (steps + 1) rows from here on.
    counts = (
        rows.select(stratum, "_good", F.inline(F.array(*bucket)))
        .groupBy(stratum, "rule", "bucket")
        .agg(F.sum("_good").cast("long").alias("good"), F.sum(1 - F.col("_good")).cast("long").alias("bad"))
    )
    counts = durable(counts, "quality-counts")
    tests = max(1, counts.select(stratum, "rule").distinct().count())
    of = Window.partitionBy(stratum, "rule")
    looser = of.orderBy(F.desc("bucket"))
    # Cutoffs in between reject the same rows, so those at the buckets that occur are enough.
    tested = counts.select(
        stratum, "rule", "bucket",
        (F.sum("good").over(looser.rowsBetween(Window.unboundedPreceding, -1))).alias("_k"),
        (F.sum("bad").over(looser.rowsBetween(Window.unboundedPreceding, -1))).alias("_bad"),
        F.sum("good").over(of).alias("_n"),
    ).withColumns({"_k": F.coalesce("_k", F.lit(0)), "_bad": F.coalesce("_bad", F.lit(0))})
    p_value = binomial_tail(F.col("_k"), F.col("_n"), false_rejection / len(RATIOS))
    passed = (
        tested.withColumn("_fails", (p_value > level / tests).cast("int"))
        .withColumn("_failed", F.max("_fails").over(looser.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("_failed") == 0) & (F.col("_bad") > 0))
    )
    net = F.col("_bad") - F.col("_k")
    best = passed.groupBy(stratum, "rule").agg(
        F.max_by(F.col("bucket") / F.lit(float(steps)), F.struct(net.alias("net"), F.col("bucket"))).alias("cutoff")
    )
    return best.groupBy(stratum).pivot("rule", list(RATIOS)).agg(F.first("cutoff")).select(
        stratum, *[F.col(r).alias(f"max_{r}") for r in RATIOS]
    )


def judged(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``; the cutoffs are a row per stratum."""
    limits = cutoffs.withColumnRenamed(stratum, "_stratum")
    out = scored.join(limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    broken = [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RATIOS]
    rejected = broken[0]
    for b in broken[1:]:
        rejected = rejected | b
    return (
        out.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .drop("_stratum", *[f"max_{r}" for r in RATIOS])
    )


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts do not move: the ratios of one pass fix the cutoffs, a second pass applies
    them. A null or empty text has no words and is rejected; repeated rows are judged
    alike; an empty table gives an empty one.
    """
    names = docs.columns
    narrow = docs.select("doc_id", "lang", "text")
    cutoffs = durable(
        certified_cutoffs(with_ratios(text_counts(narrow)).drop("text"), labels), "quality-cutoffs"
    )
    # The row travels as one struct, so that columns of the input cannot clash.
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text", "lang")
    passed = judged(with_ratios(text_counts(boxed)), cutoffs).where("kept")
    return passed.select("_row.*")
