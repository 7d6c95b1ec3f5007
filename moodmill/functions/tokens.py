"""Tokens, n-grams and padded sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def plain_text_split(c: Column) -> Column:
    """Split at single spaces; empty items are kept."""
    return F.split(c, " ")


def char_split(c: Column) -> Column:
    """The code points of a text; none for the empty text."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.expr(NO_STRINGS))


def find_ngrams(c: Column, n: int) -> Column:
    """Character n-grams in order of position, repeats kept.

    A look-ahead captures the gram while one code point is consumed, so the cost
    is linear in the text; cutting by position would walk the text for each gram.
    """
    if n <= 0:
        return F.when(c.isNotNull(), F.expr(NO_STRINGS))
    if n == 1:
        return char_split(c)
    return F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def word_ngrams(c: Column, min_len: int = 3, max_len: int = 6) -> Column:
    """N-grams of ``<word>`` by rising length, plus the bare word if it is under 3 characters."""
    marked = F.concat(F.lit("<"), c, F.lit(">"))
    grams = [find_ngrams(marked, n) for n in range(min_len, max_len + 1)]
    bare = F.when(F.length(c) < 3, F.array(c)).otherwise(F.expr(NO_STRINGS))
    return F.concat(*grams, bare)


def exploded(c: Column, with_position: bool = False) -> Column:
    """One row per item; an empty array leaves one null row, for the caller to drop.

    A plain explode would have the optimizer test the array for emptiness in a
    filter of its own and so compute it twice.
    """
    return F.posexplode_outer(c) if with_position else F.explode_outer(c)


def pad_sequence(c: Column, max_len: int, pad: Column | int | str = 0) -> Column:
    """Pad on the right and cut to ``max_len`` items."""
    filler = pad if isinstance(pad, Column) else F.lit(pad)
    return F.slice(F.concat(c, F.array_repeat(filler, max_len)), 1, max_len)


def pad_words(c: Column, max_len: int) -> Column:
    """Pad a word sequence with the one-space word."""
    return pad_sequence(c, max_len, F.lit(" "))


def sequence_length(c: Column, max_len: int) -> Column:
    """Length of a sequence before padding, at most ``max_len``."""
    return F.least(F.size(c), F.lit(max_len))
