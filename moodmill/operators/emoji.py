"""Emoji counting, filtering and labelling against a dictionary table.

The dictionary has columns ``emoji STRING, is_64 BOOLEAN``; the entries with
``is_64`` are the label set. Counts are non-overlapping substring counts, each
emoji on its own, so an emoji that contains another one counts for both.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from moodmill.functions.tokens import exploded
from moodmill.operators.lookup import lookup

# A dictionary up to this size is held as a constant of the plan; a larger one is joined.
CONSTANT_ENTRIES = 20_000
_ENTRY = "struct<emoji:string,is_64:boolean>"
_GAP = 255


@dataclass(frozen=True)
class FilterConfig:
    """Rules of ``emoji_filter``."""

    min_len: int = 5
    only_one_type: bool = True
    exclude_non64: bool = True
    only_one64_block: bool = False


def _key_point(emoji: Column) -> Column:
    """One code point that a text must hold to hold the emoji; not ASCII if possible."""
    other = F.regexp_extract(emoji, r"[^\x00-\x7f]", 0)
    return F.when(other != "", other).otherwise(F.substring(emoji, 1, 1))


def _point_class(points: set[str]) -> str:
    """A regex class of few ranges that covers all given code points, and maybe more."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, points)):
        if ranges and code - ranges[-1][1] <= _GAP and (code > 127) == (ranges[-1][0] > 127):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@dataclass(frozen=True)
class EmojiDictionary:
    """A dictionary table, with its entries at hand if there are few enough."""

    frame: DataFrame
    by_point: dict[str, list[tuple[str, bool]]] | None

    @staticmethod
    def of(source: DataFrame | EmojiDictionary) -> EmojiDictionary:
        """Prepare a dictionary for reuse in several operators."""
        if isinstance(source, EmojiDictionary):
            return source
        # An entry that stands twice is one entry, of the label set if any of them is.
        entries = source.where(F.length("emoji") > 0).groupBy("emoji").agg(F.bool_or("is_64").alias("is_64"))
        frame = entries.select("emoji", "is_64", _key_point(F.col("emoji")).alias("_point"))
        rows = frame.limit(CONSTANT_ENTRIES + 1).collect()
        if len(rows) > CONSTANT_ENTRIES:
            return EmojiDictionary(frame, None)
        by_point = defaultdict(list)
        for emoji, is_64, point in rows:
            by_point[point].append((emoji, is_64))
        return EmojiDictionary(frame, dict(by_point))

    def points(self, text: Column) -> Column:
        """Distinct code points of a text under which the dictionary may have an entry."""
        if self.by_point is None:
            return F.array_distinct(F.split(text, ""))
        if not self.by_point:
            return F.expr("CAST(array() AS ARRAY<STRING>)")
        return F.array_distinct(
            F.regexp_extract_all(text, F.lit(_point_class(set(self.by_point))), F.lit(0))
        )

    def may_hold_label(self, text: Column) -> Column:
        """False only if the raw text cannot hold any label emoji, whatever cleaning deletes."""
        if self.by_point is None:
            return F.lit(True)
        points = {p for p, entries in self.by_point.items() if any(is_64 for _, is_64 in entries)}
        return text.rlike(_point_class(points)) if points else F.lit(False)

    def with_candidates(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """Add the sorted entries whose key code point occurs in the text."""
        if self.by_point is not None:
            shaped = {
                p: [{"emoji": e, "is_64": s} for e, s in entries] for p, entries in self.by_point.items()
            }
            table = F.from_json(
                F.lit(json.dumps(shaped, ensure_ascii=False)), f"map<string,array<{_ENTRY}>>"
            )
            none = F.expr(f"CAST(array() AS ARRAY<{_ENTRY}>)")
            found = F.flatten(
                F.transform(self.points(F.col(text)), lambda p: F.coalesce(F.try_element_at(table, p), none))
            )
            return df.withColumn(name, F.array_sort(found))
        # Too many entries for a constant: join them per distinct text.
        texts = df.select(text).distinct()
        matched = lookup(
            texts.withColumn("_point", F.explode(self.points(F.col(text)))), self.frame, "_point", "inner"
        )
        held = matched.where(F.contains(text, "emoji") | F.col("is_64")).groupBy(text).agg(
            F.array_sort(F.collect_list(F.struct("emoji", "is_64"))).alias(name)
        )
        joined = lookup(df, held, text, "left")
        return joined.withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS ARRAY<{_ENTRY}>)")))


def occurrences(text: Column, part: Column) -> Column:
    """Number of non-overlapping occurrences of ``part``."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return (removed / F.length(part)).cast("long")


def _hits(text: Column, candidates: Column) -> Column:
    counted = F.transform(
        candidates,
        lambda e: F.struct(
            e["emoji"].alias("emoji"), e["is_64"].alias("is_64"), occurrences(text, e["emoji"]).alias("n")
        ),
    )
    return F.filter(counted, lambda h: h["n"] > 0)


def _without_labels(text: Column, candidates: Column) -> Column:
    """Delete the label emojis one after another in sorted order.

    Deleting adds no code point, so entries that are no candidates cannot come up;
    candidates that do not occur yet may, which is why hits alone would not do.
    """
    labels = F.filter(candidates, lambda e: e["is_64"])
    return F.aggregate(labels, text, lambda acc, e: F.replace(acc, e["emoji"], F.lit("")))


def emoji_counts_detailed(df: DataFrame, dictionary: DataFrame | EmojiDictionary, text: str = "text") -> DataFrame:
    """One row per text and emoji in it: the columns of ``df``, ``emoji, is_64, n``."""
    d = EmojiDictionary.of(dictionary)
    pointed = df.withColumn("_point", exploded(d.points(F.col(text)))).where(F.col("_point").isNotNull())
    matched = lookup(pointed, d.frame, "_point", "inner")
    counted = matched.withColumn("n", occurrences(F.col(text), F.col("emoji")))
    return counted.where(F.col("n") > 0).select(*df.columns, "emoji", "is_64", "n")


def emoji_counts(df: DataFrame, dictionary: DataFrame | EmojiDictionary, text: str = "text") -> DataFrame:
    """``emoji_counts_detailed`` for the label set only, without ``is_64``."""
    d = EmojiDictionary.of(dictionary)
    labels = EmojiDictionary(
        d.frame.where("is_64"),
        None
        if d.by_point is None
        else {p: kept for p, es in d.by_point.items() if (kept := [e for e in es if e[1]])},
    )
    return emoji_counts_detailed(df, labels, text).drop("is_64")


def remove64_emojis(
    df: DataFrame, dictionary: DataFrame | EmojiDictionary, text: str = "text", name: str = "rest"
) -> DataFrame:
    """Add the text with the label emojis deleted in sorted order."""
    d = EmojiDictionary.of(dictionary)
    held = d.with_candidates(df, text, "_candidates")
    return held.withColumn(name, _without_labels(F.col(text), F.col("_candidates"))).drop("_candidates")


def emoji_single_block(text: Column, emoji: Column) -> Column:
    """True if the emoji stands in one consecutive run at most."""
    marked = F.replace(text, emoji, F.lit("⁂"))
    return F.size(F.regexp_extract_all(marked, F.lit("⁂+"), F.lit(0))) <= 1


def _label(hits: Column) -> Column:
    """The most frequent label emoji as ``(n negated, emoji)``; ties go to the lowest code point."""
    labels = F.filter(hits, lambda h: h["is_64"])
    return F.array_min(F.transform(labels, lambda h: F.struct((-h["n"]).alias("n"), h["emoji"].alias("emoji"))))


def emoji_verdict(
    df: DataFrame,
    dictionary: DataFrame | EmojiDictionary,
    config: FilterConfig = FilterConfig(),
    text: str = "text",
) -> DataFrame:
    """Add ``class, count, reject_reason``: the label and why a text is refused, if it is.

    All three come from one count per text. With a dictionary held as a constant
    the whole step is a projection.
    """
    d = EmojiDictionary.of(dictionary)
    held = d.with_candidates(df, text, "_candidates")
    held = held.withColumn("_rest", _without_labels(F.col(text), F.col("_candidates")))
    # The one-element explode keeps the optimizer from inlining the counts into each use.
    held = held.withColumn("_hits", F.explode(F.array(_hits(F.col(text), F.col("_candidates")))))
    held = held.withColumn("_label", _label(F.col("_hits")))
    hits, rest = F.col("_hits"), F.col("_rest")
    kinds = F.size(F.filter(hits, lambda h: h["is_64"]))
    # The length first, so that only texts of a few characters are split into words.
    short = (F.length(rest) < config.min_len) & (F.size(F.split(rest, " ")) < config.min_len)
    reason = F.when(F.col("_label").isNull(), "no_emoji")
    if config.exclude_non64:
        reason = reason.when(F.exists(hits, lambda h: ~h["is_64"]), "other_emoji")
    if config.only_one_type:
        reason = reason.when(kinds > 1, "several_types")
    reason = reason.when(short, "too_short")
    if config.only_one64_block:
        reason = reason.when(~emoji_single_block(F.col(text), F.col("_label.emoji")), "several_blocks")
    return held.select(
        *df.columns,
        F.col("_label.emoji").alias("class"),
        (-F.col("_label.n")).alias("count"),
        reason.alias("reject_reason"),
    )


def emoji_filter(
    df: DataFrame,
    dictionary: DataFrame | EmojiDictionary,
    config: FilterConfig = FilterConfig(),
    text: str = "text",
) -> DataFrame:
    """Add ``reject_reason``; null means the text is kept."""
    return emoji_verdict(df, dictionary, config, text).drop("class", "count")


def emoji_label(df: DataFrame, dictionary: DataFrame | EmojiDictionary, text: str = "text") -> DataFrame:
    """Add ``class, count``: the most frequent label emoji of each text, null if it has none."""
    return emoji_verdict(df, dictionary, text=text).drop("reject_reason")


def emojis_non64(dictionary: DataFrame) -> DataFrame:
    """Emojis outside the label set."""
    labels = dictionary.where("is_64").select("emoji")
    return dictionary.select("emoji").join(labels, "emoji", "left_anti").distinct()
