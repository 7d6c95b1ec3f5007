"""Substring deduplication by content-defined chunks.

The words of a text, A-Z lower-cased and joined by single spaces, are cut where a gear
rolling hash of the last 16 bytes has its top bits zero. A cut moves to the next word
start. Cuts depend on what stands just before them, so text inserted elsewhere does not
move them and equal passages get equal chunks beyond their edges.

Chunks are deduplicated by a 128-bit digest: the document with the smallest key that has
a digest keeps it. A stretch of neighbouring chunks that an earlier document holds is a
repeated passage if it has enough words; shorter ones occur by chance and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from moodmill.llm.common import durable

CUT_BITS = 5  # a cut about every 32 bytes beyond the least size
MIN_BYTES = 12
MAX_BYTES = 512
MIN_WORDS = 15
WINDOW_BYTES = 16
_PIECE = 1 << 22


def _gear() -> np.ndarray:
    # 256 fixed pseudo-random numbers: the digests of the byte values.
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def gear_hash(raw: bytes) -> np.ndarray:
    """The rolling hash at each byte: the gears of the last 16 bytes, shifted by their age and added.

    Built by doubling: the hash over 2k bytes is that over k, plus that of k bytes
    earlier shifted by k.
    """
    hashes = GEAR[np.frombuffer(raw, dtype=np.uint8)]
    step = 1
    while step < WINDOW_BYTES:
        longer = hashes.copy()
        longer[step:] += hashes[:-step] << np.uint32(step)
        hashes, step = longer, 2 * step
    return hashes


def chunk_bounds(words: list[bytes]) -> list[int]:
    """Word positions at which chunks begin, and the number of words at the end."""
    if not words:
        return [0]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    joined = b" ".join(words)
    cuts = []
    for at in range(0, len(joined), _PIECE):  # a long text goes through in pieces that overlap by a window
        low = max(0, at - WINDOW_BYTES)
        found = np.flatnonzero(gear_hash(joined[low : at + _PIECE]) >> np.uint32(32 - CUT_BITS) == 0) + low
        cuts.append(found[found >= at])
    # The first word that begins after the cut.
    candidates = np.unique(np.searchsorted(starts, np.concatenate(cuts), side="right"))
    places = starts[candidates[candidates < len(words)]].tolist()
    bounds, last = [0], 0
    first_of = dict(zip(places, candidates.tolist()))
    total = len(joined)
    for place in [*places, total]:
        while place - last > MAX_BYTES:  # no cut for long: the word that begins at or after the limit
            word = int(np.searchsorted(starts, last + MAX_BYTES, side="left"))
            if word >= len(words) or starts[word] >= place:
                break
            bounds.append(word)
            last = int(starts[word])
        if place < total and place - last >= MIN_BYTES:
            bounds.append(first_of[place])
            last = place
    return [*bounds, len(words)]


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, stop, high, low``: the chunks of each text as word positions, and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            starts: list[int] = []
            stops: list[int] = []
            digests: list[bytes] = []
            for i, t in enumerate(batch.column(1)):
                words = _words(t.as_py())
                bounds = chunk_bounds(words)
                index += [i] * (len(bounds) - 1)
                starts += bounds[:-1]
                stops += bounds[1:]
                digests += [
                    xxhash.xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(bounds, bounds[1:])
                ]
            pair = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(starts, pa.int32()),
                 pa.array(stops, pa.int32()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                ["key", "start", "stop", "high", "low"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start int, stop int, high bigint, low bigint"
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key, start, stop, first``: stretches of words that documents with smaller keys hold.

    ``first`` is the one of those documents that holds most of the stretch. A
    document without repeated passages has no row. Null and empty texts, and rows without
    a key, have no chunks; rows that repeat a key are one document, whose spans are given
    once; repeats within one document are left.
    """
    cut = durable(chunks(docs, key, text), "chunks")
    shared = durable(
        cut.groupBy("high", "low").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .where(F.col("first") < F.col("last")).drop("last"),
        "shared-chunks",
    )
    met = cut.join(shared, ["high", "low"]).where(F.col("first") < F.col("key"))
    # The chunks of one document; no other group is gathered.
    gathered = met.groupBy("key").agg(F.collect_set(F.struct("start", "stop", "first")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, held in enumerate(batch.column(1)):
                for a, b, first in stretches(held.as_py(), min_words):
                    index.append(i)
                    rows.append((a, b, first))
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind)],
                ["key", "start", "stop", "first"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = gathered.mapInArrow(run, f"key {kind}, start int, stop int, first {kind}")
    return found.withColumnRenamed("key", key)


def stretches(held: list[dict], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Neighbouring chunks joined to ``start, stop, first``; those with too few words are left out.

    The chunks of a stretch may be first held by several documents; ``first`` is the one
    that holds most of its words, the smallest of equals.
    """
    joined: list[list[dict]] = []
    for chunk in sorted(held, key=lambda c: (c["start"], c["stop"])):
        if joined and chunk["start"] == joined[-1][-1]["stop"]:
            joined[-1].append(chunk)
        else:
            joined.append([chunk])
    out = []
    for run in joined:
        start, stop = run[0]["start"], run[-1]["stop"]
        if stop - start >= min_words:
            words: dict[int, int] = {}
            for c in run:
                words[c["first"]] = words.get(c["first"], 0) + c["stop"] - c["start"]
            out.append((start, stop, min(words, key=lambda f: (-words[f], f))))
    return out


def cut_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the whitespace after them."""
    raw = text.encode("utf-8", "surrogatepass")
    space = np.isin(np.frombuffer(raw, dtype=np.uint8), (9, 10, 11, 12, 13, 32))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8)))) == -1)
    begins = [*edge.tolist(), len(raw)]
    parts, at = [], 0
    for a, b in sorted(spans):
        parts.append(raw[at : begins[a]])
        at = begins[b]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut from the texts that do not hold it first."""
    names = docs.columns
    spans = (
        repeated_passages(docs, key, text, min_words)
        .groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    )
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text")
    )
    met = boxed.join(durable(spans, "spans"), "_key", "left").select("_row", "_text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut_passages(t, [(s["start"], s["stop"]) for s in own]) if own else t
                for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    schema = T.StructType([met.schema["_row"], T.StructField("_text", T.StringType())])
    done = met.mapInArrow(run, schema)
    return done.select(*[F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names])
