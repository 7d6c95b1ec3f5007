"""Exact duplicates and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def dedup(df: DataFrame, scope: str = "file", dependent: tuple[str, ...] = ()) -> DataFrame:
    """Drop exact duplicates of ``text`` per ``source_file``, or over all files.

    Columns named in ``dependent`` follow from the text, as its label does. They
    join the keys, so that with no other columns the distinct is one hash
    aggregate, which drops most copies before the shuffle. Of other columns those
    of one of the copies are kept. Over all files ``source_file`` is left out.
    """
    if scope == "file":
        return df.dropDuplicates(["source_file", "text", *dependent])
    if scope == "all":
        return df.drop("source_file").dropDuplicates(["text", *dependent])
    raise ValueError(f"unknown scope {scope!r}")


def combine_batches(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all batches, columns matched by name."""
    return reduce(DataFrame.unionByName, dfs)
