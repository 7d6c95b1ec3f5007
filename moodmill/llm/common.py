"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moodmill.session import durable

__all__ = ["beside", "by_key", "byte_alphabet", "durable", "given", "ranked", "whole_runs", "WHITESPACE"]

# Fixed value: the characters that part words, as a class of a regular expression.
WHITESPACE = r"[\x20\x09-\x0D]"

_ROW_BITS = 33


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order_by: list[Column], name: str = "ordinal") -> DataFrame:
    """Add the dense 0-based rank of each row in the given order, without a one-task window.

    A range sort places the rows and is written once; each partition numbers its own
    rows and the row counts of the partitions before it are added. The driver sees one
    count per partition. Equal rows get neighbouring ranks. Columns of any name stay.
    """
    at = "_placed"
    while at.lower() in {c.lower() for c in [*df.columns, name]}:
        at += "_"
    placed = durable(df.orderBy(*order_by).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, _ROW_BITS)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate([0, *(counts.get(p, 0) for p in range(max(counts, default=0)))]))
    offset = F.get(F.expr("array(" + ",".join(f"{s}L" for s in starts) + ")"), part.cast("int"))
    row = F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, (offset + row).cast("long")).drop(at)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Gather the batches of a partition sorted by ``keys`` into tables that cut no run of equal keys.

    A table holds about ``rows`` rows, or one run if that is longer.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[n - 1] for k in keys]
        low, high = 0, n - 1  # the first row of the last run, by bisection
        while low < high:
            mid = (low + high) // 2
            if [table.column(k)[mid] for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        if low:
            yield table.slice(0, low)
            rest = table.slice(low)
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def beside(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Rows of two tables with a common ``key`` in one partition, sorted by it, those of ``side`` first.

    The column ``side`` tells them apart; columns of the other table are null. What a task
    needs for the rows of a key arrives just before them, so nothing is broadcast and no
    group is held. Column names are unique but for the key.
    """
    both = side.withColumn("side", F.lit(True)).unionByName(rows.withColumn("side", F.lit(False)), allowMissingColumns=True)
    return both.repartition(key).sortWithinPartitions(F.col(key), F.col("side").desc())


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of a partition sorted by an integer key, cut where it changes; a key may come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield int(values[a]), batch.slice(a, b - a)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
