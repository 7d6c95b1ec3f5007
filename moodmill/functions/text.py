r"""Text cleaning as column expressions.

All of them are built-in string functions without lambdas, so a whole cleaning
chain stays inside one generated stage and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes of characters and tokens the cleaning rules are defined on.
PUNCTUATION = r"!-/:-@\[-`{-~"
CONTROL = r"\x00-\x1f\x7f-\x9f"
SPACE = r"\s\x1c-\x1f"  # with the flag (?U); the four separators are blanks here, too
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
KEPT = r" -\[\]-~а-яА-ЯёЁ\t\n\x0B\f\r"
ENTITIES = ("&amp;", "&lt;", "&br;", "&gt;")
RETWEET = "RT "


def strip_whitespace(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def trim_string(c: Column) -> Column:
    """Collapse runs of Unicode whitespace to one space and strip the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))


def remove_control_chars(c: Column) -> Column:
    """Delete control characters; the text on both sides is joined."""
    return F.regexp_replace(c, rf"[{CONTROL}]", "")


def remove_links(c: Column) -> Column:
    """Delete ``http`` with all that follows up to whitespace, then strip."""
    return strip_whitespace(F.regexp_replace(c, rf"(?U)http[^{SPACE}]+", ""))


def remove_tags(c: Column) -> Column:
    """Drop retweet marks, entities, mentions and hash tags."""
    text = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(RETWEET), F.lit(""))
    for entity in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(" "))
    # With one leading space every word owns the space before it, so dropping a
    # word is one replacement and the first character is cut at the end.
    led = F.concat(F.lit(" "), trim_string(text))
    kept = F.regexp_replace(led, " [@#][^ ]*", "")
    return F.substring(kept, 2, 2147483647)


def space_punctuation(c: Column, remove: bool = True, max_smile_len: int = 4) -> Column:
    """Turn ASCII punctuation into spaces, or set short runs of it apart.

    With ``remove=False`` each run is cut to ``max_smile_len`` characters (one at
    least) and surrounded by spaces, which keeps smileys as tokens.
    """
    if remove:
        # A run of punctuation and whitespace ends as one space; one pass does both.
        return F.trim(F.regexp_replace(c, rf"(?U)[{PUNCTUATION}{SPACE}]+", " "))
    keep = max(1, max_smile_len)
    run = f"([{PUNCTUATION}]{{1,{keep}}})[{PUNCTUATION}]*"
    return trim_string(F.regexp_replace(c, run, " $1 "))


def remove_non_printed_chars(c: Column) -> Column:
    """Replace all but Latin, Cyrillic, digits, punctuation and ASCII blanks by a space."""
    return F.regexp_replace(c, f"[^{KEPT}]", " ")


def process_text(c: Column) -> Column:
    """Printable text with ``". "`` and ``", "`` deleted; the case is kept."""
    text = trim_string(remove_non_printed_chars(c))
    return F.replace(F.replace(text, F.lit(". "), F.lit("")), F.lit(", "), F.lit(""))


def process_text_dataset(c: Column) -> Column:
    """Lower case without punctuation, as the training frame holds it."""
    return space_punctuation(F.lower(c))


def process_tweets(c: Column) -> Column:
    """The whole tweet cleaning: control characters, links, tags, punctuation."""
    return space_punctuation(remove_tags(remove_links(remove_control_chars(c))))


def has_punctuation(c: Column) -> Column:
    """True if any ASCII punctuation character occurs."""
    return c.rlike(f"[{PUNCTUATION}]")


def str_contains(needle: Column | str, c: Column) -> Column:
    """True if ``needle`` is a substring of ``c``."""
    return F.contains(c, F.lit(needle) if isinstance(needle, str) else needle)
