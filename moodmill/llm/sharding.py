"""Shards by a Feistel permutation of the global row numbers.

Rows are numbered 0 to N-1 in the order of their key. A keyed Feistel network permutes
the numbers below the next even power of two; numbers at or above N walk on through the
cycle until they fall below N, which makes a permutation of 0 to N-1. The shard is the
permuted number modulo the number of shards, the slot the quotient. So counts of shards
differ by one at most, slots have no gaps, and both follow from row number, N and seed
alone; the inverse finds the row that stands in a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from moodmill.llm.common import ranked

SHARDS = 40
SEED = 7_919
ROUNDS = 4

# Odd constants of a 64-bit mixer with good avalanche.
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray, round_key: int) -> np.ndarray:
    x = x + np.uint64(round_key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of the numbers 0 to ``n - 1``, with its inverse."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.half = np.uint64(half)
        self.mask = np.uint64((1 << half) - 1)
        self.keys = [(seed * 1_000_003 + (i + 1) * _STEP) for i in range(rounds)]

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right, key) & self.mask)
        return left << self.half | right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ (_mix(left, key) & self.mask), left
        return left << self.half | right

    def _walk(self, numbers: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(numbers, dtype=np.uint64))
        outside = np.flatnonzero(out >= np.uint64(self.n))
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._forward)

    def inverse(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._backward)


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that stands in a slot of a shard."""
    return int(Permutation(n, seed).inverse(np.array([slot * shards + shard]))[0])


def sharded(docs: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to the rows, numbered in the given order.

    Ties go by a hash of the whole row, so that only equal rows may swap their places; a
    null comes first in the order. Repeated rows are rows of their own. An empty table
    gives an empty one. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("row_number", "shard", "slot")]
    every = [F.col(f"`{c}`") for c in names]
    # Sort keys are sampled by the driver, so a long text is no sort key itself.
    numbered = ranked(docs.select(*every), [*[F.col(f"`{c}`") for c in order], F.xxhash64(*every)], "row_number")
    n = numbered.count()
    permutation = Permutation(n, seed)
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = permutation(batch.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((placed % shards).astype(np.int32)), pa.array(placed // shards)],
                [*batch.schema.names, "shard", "slot"],
            )

    schema = T.StructType([
        *numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())
    ])
    return numbered.mapInArrow(run, schema)
