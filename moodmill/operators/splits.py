"""Training frame, reproducible split, row order and batches."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from moodmill.functions.text import process_text_dataset
from moodmill.operators.lookup import lookup
from moodmill.operators.ordering import with_ordinal
from moodmill.session import durable

# The share of validation rows, and the seed.
HOLDOUT_SHARE = 0.25
SEED = 228
_DIGITS = 3
_KEY_DIGITS = 32
_BORDER_ROWS = 10_000


def assemble_training(prepared: DataFrame, label_map: DataFrame, id_from: tuple[str, ...] = ("source_file", "text")) -> DataFrame:
    """``row_id, processed, target, lang`` of the prepared rows whose class is in ``label_map(emoji, target)``.

    ``row_id`` is a repeatable hash of the columns ``id_from``, each with its length, a null apart
    from an empty text. It is unique where they are, as source file and text are after the
    preparation. A column that lacks is an error: rows of equal text from two
    files would become one further on.
    """
    lacking = [c for c in id_from if c not in prepared.columns]
    if lacking:
        raise ValueError(f"row ids need the columns {', '.join(lacking)}; prepare them with their source, or name others in id_from")
    targets = label_map.select(F.col("emoji").alias("class"), "target")
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null")) for c in id_from]
    row_id = F.md5(F.concat_ws("|", *parts))
    return lookup(prepared.withColumn("row_id", row_id), targets, "class", "inner").select(
        "row_id", process_text_dataset(F.col("text")).alias("processed"), "target", "lang"
    )


def shuffle_key(row_id: Column, *parts: object) -> Column:
    """A repeatable pseudo-random key of a row: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) for p in parts], row_id.cast("string")))


def _border(keys: DataFrame, share: float) -> str:
    """The key up to which the first ``ceil(share * n)`` rows in key order lie, ``''`` if there are none.

    ``keys`` holds keys ``k`` that stand for ``n`` rows each, or for one without such a column. Counts rows per key prefix,
    descends into the prefix that holds the border, and sorts only the last one. Each pass
    returns at most 4096 rows, and the rows themselves never move.
    """
    if "n" not in keys.columns:
        keys = keys.withColumn("n", F.lit(1))
    prefix, wanted = "", None
    while True:
        digits = len(prefix) + _DIGITS
        counts = sorted(
            keys.where(F.col("k").startswith(prefix))
            .groupBy(F.substring("k", 1, digits).alias("p"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
            .collect()
        )
        if wanted is None:
            wanted = math.ceil(share * sum(r.n for r in counts))
            if wanted <= 0:
                return ""
        for prefix, n, n_keys in counts:
            if wanted <= n:
                break
            wanted -= n
        if n_keys <= _BORDER_ROWS or digits >= _KEY_DIGITS:
            inside = keys.where(F.col("k").startswith(prefix)).orderBy("k").limit(min(wanted, _BORDER_ROWS) + 1)
            found = inside.collect()
            ends = list(accumulate(r.n for r in found))
            last = next((i for i, end in enumerate(ends) if end >= wanted), None)
            if last is None or found[last].k in [r.k for r in found[last + 1 : last + 2]]:
                raise ValueError("row ids are not unique: the border of the holdout falls among equal ones")
            return found[last].k


def holdout_split(
    df: DataFrame, row_id: str, share: float = HOLDOUT_SHARE, seed: int = SEED, name: str = "is_val",
    group: str | None = None,
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows as validation rows.

    The border between the sides is found by counting; the split itself is a
    comparison per row without a shuffle. ``row_id`` must be unique.

    With ``group``, the rows that agree in that column are on one side, so that no text, say, is learned
    and validated; those with a null there are one group. The group at the border is a whole
    validation group: the side has fewer rows than that group too many. Row ids play no
    part then. Only the distinct keys of the groups with their numbers are shuffled.
    """
    key = shuffle_key(F.col(group or row_id), seed)
    if group:
        keys = durable(df.groupBy(key.alias("k")).agg(F.count("*").alias("n")), "groups")
    else:
        keys = df.select(key.alias("k"))
    return df.withColumn(name, key <= F.lit(_border(keys, share)))


def split_mode(df: DataFrame, mode: str, name: str = "is_val") -> DataFrame:
    """The rows of one side, ``'train'`` or ``'val'``."""
    if mode not in ("train", "val"):
        raise ValueError(f"unknown mode {mode!r}")
    side = F.col(name) if mode == "val" else ~F.col(name)
    return df.where(side).drop(name)


def shuffle_rows(df: DataFrame, row_id: str, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """All rows in a pseudo-random order that depends on the seed and the epoch."""
    return df.orderBy(shuffle_key(F.col(row_id), seed, epoch), F.col(row_id))


def assign_batches(df: DataFrame, n: int, order_by: list[Column]) -> DataFrame:
    """Add ``batch``: consecutive runs of ``n`` rows in the given order."""
    return (
        with_ordinal(df, order_by, "_ordinal")
        .withColumn("batch", F.floor(F.col("_ordinal") / n).cast("long"))
        .drop("_ordinal")
    )
