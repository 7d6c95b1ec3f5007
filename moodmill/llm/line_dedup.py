"""Line deduplication with two Bloom filters.

1. Every task puts the hashes of its lines into two filters of its own: seen once, and
   seen again. Filters of tasks merge block by block: what two tasks have both seen once
   has been seen again. The merge is associative, so a block streams through one task
   in any order.
2. Lines in the second filter are suspected repeats. Only their 128-bit digests and keys
   are shuffled; counting them is exact and tells in which documents they stand.
3. Documents without a suspected line are finished where they are read. The others meet
   the digests they lose in one join.

The filter has 16 bits per line up to a fixed size, so what is broadcast is bounded.
Beyond that size more lines are suspected and shuffled; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from moodmill.llm.common import durable

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 16
MIN_BITS = 1 << 20  # also the size of a block
MAX_BITS = 1 << 29
_BLOCK_BYTES = MIN_BITS // 8


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their digests; None for a line whose key is too short.

    A key is the line without whitespace at its ends, A-Z lower-cased. A null text is
    one empty line.
    """
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digests: list[bytes | None] = []
    for line in lines:
        # bytes.strip takes exactly 0x20 and 0x09-0x0D, bytes.lower changes A-Z only.
        key = line.strip().lower()
        size = len(key)
        long = size >= 4 * min_chars or (
            size >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars
        )
        digests.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, digests


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


class RepeatFilter:
    """Bit sets of hashes seen once and of hashes seen again, two bits per hash."""

    def __init__(self, bits: int, again: np.ndarray | None = None):
        self.bits = bits
        self.once = np.zeros(bits // 8, dtype=np.uint8) if again is None else again
        self.again = np.zeros(bits // 8, dtype=np.uint8) if again is None else again

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Both bits lie in one block, so that a block is a filter of its own.
        first = hashes[:, 0] & np.uint64(self.bits - 1)
        second = (first & np.uint64(~(MIN_BITS - 1) & (1 << 64) - 1)) | (hashes[:, 1] & np.uint64(MIN_BITS - 1))
        return first.astype(np.int64), second.astype(np.int64)

    @staticmethod
    def _has(array: np.ndarray, spots: np.ndarray) -> np.ndarray:
        return (array[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)

    @staticmethod
    def _set(array: np.ndarray, spots: np.ndarray) -> None:
        np.bitwise_or.at(array, spots >> 3, np.uint8(1) << (spots & 7).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """Add hashes, each of which stands for one document."""
        hashes, counts = np.unique(hashes, axis=0, return_counts=True)
        one, two = self._spots(hashes)
        seen = (counts > 1) | self._has(self.once, one) & self._has(self.once, two)
        for spots in (one, two):
            self._set(self.again, spots[seen])
            self._set(self.once, spots)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may have been seen again; never wrong where it has."""
        one, two = self._spots(hashes)
        return self._has(self.again, one) & self._has(self.again, two)


def _filter_bits(lines: int) -> int:
    bits = MIN_BITS
    while bits < min(lines * BITS_PER_LINE, MAX_BITS):
        bits *= 2
    return bits


def repeat_filter(rows: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged filter of lines seen again over rows ``key, text``; ``bits / 8`` bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = RepeatFilter(bits)
        for batch in batches:
            found = [d for t in batch.column(0) for d in set(line_keys(t.as_py(), min_chars)[1]) if d is not None]
            if found:
                own.add(_hashes(found))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(bits // MIN_BITS):
            part = slice(i * _BLOCK_BYTES, (i + 1) * _BLOCK_BYTES)
            if own.once[part].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([pack(own.once[part].tobytes())], pa.binary()),
                     pa.array([pack(own.again[part].tobytes())], pa.binary())],
                    ["block", "once", "again"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                once, again = (np.frombuffer(unpack(x), dtype=np.uint8) for x in (once, again))
                if block in held:
                    had = held[block]
                    held[block] = [had[0] | once, had[1] | again | had[0] & once]
                else:
                    held[block] = [once, again]
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, (_, again) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([pack(again.tobytes())], pa.binary())], ["block", "again"]
            )

    parts = rows.select("text").mapInArrow(build, "block int, once binary, again binary")
    merged = parts.repartition("block").mapInArrow(merge, "block int, again binary")
    again = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():  # at most MAX_BITS / 8 bytes
        again[row.block * _BLOCK_BYTES : (row.block + 1) * _BLOCK_BYTES] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(row.again), dtype=np.uint8
        )
    return again


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines cut from the text, and ``n_lines``, ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` documents stays only in the document with the largest key among them,
    there at every place. ``n_lines`` counts before dropping. A null text stays null and
    has one line; rows that repeat a key count as one document; a row without a key is
    neither counted nor cut. Columns named ``n_lines`` and ``n_dropped`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    lines = rows.agg(F.sum(F.size(F.split("text", "\n"))).alias("n")).first().n or 0
    bits = _filter_bits(lines)
    sent = spark.sparkContext.broadcast(repeat_filter(rows, bits, min_chars))

    def suspected(text: str | None) -> list[bytes]:
        found = list({d for d in line_keys(text, min_chars)[1] if d is not None})
        if not found:
            return []
        hits = RepeatFilter(bits, sent.value).repeated(_hashes(found))
        return [d for d, hit in zip(found, hits) if hit]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found = [], []
            for i, t in enumerate(batch.column(1)):
                own = suspected(t.as_py())
                index += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(found, pa.binary())], ["key", "line"]
            )

    kind = docs.schema[key].dataType.simpleString()
    doubtful = durable(rows.mapInArrow(suspects, f"key {kind}, line binary"), "suspects")
    confirmed = durable(
        doubtful.groupBy("line").agg(F.count_distinct("key").alias("n"), F.max("key").alias("holder"))
        .where(F.col("n") >= min_docs).select("line", "holder"),
        "repeats",
    )
    lost = doubtful.join(confirmed, "line").where(F.col("key") < F.col("holder"))
    drops = durable(
        lost.select("key", "line").distinct().groupBy("key").agg(F.collect_list("line").alias("_lines")), "drops"
    )

    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(key).alias("key"), F.col(text).alias("_text")
    )
    has = F.udf(lambda t: bool(suspected(t)), "boolean", useArrow=True)(F.col("_text")) & F.col("key").isNotNull()
    flagged = boxed.withColumn("_has", F.coalesce(has, F.lit(False)))
    none = F.lit(None).cast("array<binary>")
    clean = flagged.where(~F.col("_has")).select("_row", "_text", none.alias("_lines"))
    # One way of joining at every size: what is to be dropped grows with the documents.
    met = flagged.where("_has").join(drops.hint("merge"), "key", "left").select("_row", "_text", "_lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, own in zip(batch.column(1), batch.column(2)):
                t, own = t.as_py(), own.as_py()
                if own:
                    lines, digests = line_keys(t, min_chars)
                    gone = set(own)
                    stay = [line for line, d in zip(lines, digests) if d not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    t = b"\n".join(stay).decode("utf-8", "surrogatepass")
                else:
                    n_lines.append((t or "").count("\n") + 1)
                    n_dropped.append(0)
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())],
                ["_row", "_text", "n_lines", "n_dropped"],
            )

    schema = T.StructType([
        boxed.schema["_row"], T.StructField("_text", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
    ])

    def columns() -> list[Column]:
        return [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names]

    done = clean.unionByName(met).mapInArrow(cut, schema)
    return done.select(*columns(), "n_lines", "n_dropped")
