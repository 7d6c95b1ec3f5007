"""Subword ids of texts by a given model; models are read from files, never fitted here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from moodmill.functions.tokens import pad_sequence, sequence_length

# Fixed value: the id of the padding.
PAD_ID = 0


def _processor(model: bytes):
    import sentencepiece  # only the tasks that encode need it

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def subword_ids(text: Column, model: bytes) -> Column:
    """The ids of each whole text in order, ``[]`` for a null or empty one.

    ``model`` is the content of a sentencepiece file, of fixed size. Texts go to it in Arrow
    batches and do not move otherwise.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = _processor(model)
        for texts in batches:
            yield pd.Series(processor.encode(texts.fillna("").tolist(), num_threads=1))

    return encode(text)


def subword_text(ids: Column, model: bytes) -> Column:
    """The text that ids stand for; that of a null array is null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = _processor(model)
        for rows in batches:
            yield pd.Series([None if x is None else processor.decode([int(i) for i in x]) for x in rows], dtype=object)

    return decode(ids)


def subword_samples(
    df: DataFrame, keys: list[str], model: bytes, text: str = "processed", max_len: int = 100, encoded: str | None = None
) -> DataFrame:
    """``keys, ids, seq_len``: the padded subword ids of each text.

    ``encoded`` names a column that holds the ids of the texts already, as ``subword_ids`` gives them.
    """
    found = F.col(encoded) if encoded else subword_ids(F.col(text), model)
    encoded = df.select(*keys, found.alias("_ids"))
    ids = F.col("_ids").cast("array<bigint>")
    return encoded.select(
        *keys,
        pad_sequence(ids, max_len, F.lit(PAD_ID).cast("bigint")).alias("ids"),
        sequence_length(ids, max_len).alias("seq_len"),
    )
