"""Token ids in files: one shared zstandard dictionary, a frame per document, an offset index.

A store is a folder with three Parquet tables, written and read by Spark:

* ``meta``: one row: dictionary, its SHA-256, bytes per id, end id.
* ``blocks``: rows of about a megabyte. ``payload`` holds the frames of consecutive
  documents; each frame is the ids of one document as little-endian integers, compressed
  on its own with the shared dictionary. ``keys``, ``n_tokens`` and ``offsets`` are the
  index: frame i is ``payload[offsets[i]:offsets[i + 1]]``. ``dict_hash`` names the
  dictionary, so a frame is never opened with another one.
* ``parts``: per part of the ascending order, the rows and tokens before it.

A document is found by the smallest and largest key of a block, which Parquet keeps as
statistics, and only its own frame is decompressed.

Encoding is the tokenizer's own, cut to distinct pieces: a text is parted before each run
of ASCII whitespace that follows something else, and before ASCII punctuation that follows
an ASCII letter or digit. These are always borders of this kind of byte-level tokenizer;
equal pieces are encoded once and the ids put together by array operations. Texts with other whitespace or special tokens are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from moodmill.llm.common import byte_alphabet

END_ID = 2
BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS = 1_000  # the dictionary is trained on so many documents at most,
SAMPLE_BYTES = 8_192  # and on so many bytes of each
LEVEL = 3
ROOM_BYTES = 96 << 20  # of distinct pieces that a worker remembers
_PIECE_BYTES = 240  # a remembered piece beside its own bytes and ids
_BATCH = 1 << 20
_INNER, _OUTER = 20_000, 4_000  # new pieces encoded at a time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
# UTF-8 beginnings of whitespace beyond ASCII, and of special tokens.
_WHOLE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|")


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer, each distinct piece once."""

    def __init__(self, tokenizer_json: str, room: int = ROOM_BYTES):
        self.room = room
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        cut = json.loads(tokenizer_json)
        pre = cut.get("pre_tokenizer") or {}
        # Other kinds of tokenizers may look across the borders of pieces.
        self.parted = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not cut.get("normalizer")
        )
        if self.parted:
            alphabet = byte_alphabet()
            names = (self.tokenizer.id_to_token(i) or "" for i in range(size))
            self.size = np.array([len(n) if all(c in alphabet for c in n) else len(n.encode()) for n in names])  # bytes of each id
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=self.type)
        self.used = self.held = 0
        self.places = np.zeros((1 << 16, 2), dtype=np.int64)  # start and number of the ids of a piece
        self.hits = np.zeros(1 << 16, dtype=np.int64)

    def _make_room(self) -> None:
        """Drop the less used half of the pieces; the counts of the others are halved, so that they can age."""
        n = len(self.known)
        keep = np.zeros(n, dtype=bool)
        keep[np.argsort(-self.hits[:n], kind="stable")[: n // 2]] = True
        pieces = [p for p, k in zip(self.known, keep.tolist()) if k]
        start, sizes = self.places[:n][keep].T
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(start - before, sizes) + np.arange(int(sizes.sum()))]
        hits = self.hits[:n][keep] // 2
        self._forget()
        self._remember(pieces, ids, sizes)
        self.hits[: len(pieces)] = hits

    def _remember(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of new pieces, which stand one after the other in ``ids``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        number = len(self.known)
        while number + len(pieces) > len(self.places):
            self.places = np.concatenate([self.places, np.zeros_like(self.places)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.places[number : number + len(pieces), 0] = self.used + np.cumsum(sizes) - sizes
        self.places[number : number + len(pieces), 1] = sizes
        self.known.update(zip(pieces, range(number, number + len(pieces))))
        self.used += len(ids)
        self.held += _PIECE_BYTES * len(pieces) + sum(map(len, pieces)) + ids.nbytes

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, without their places in the text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces. Those that begin with whitespace go as one text, which the tokenizer parts again."""
        inner, outer = [], []
        for p in pieces:  # bytes.isspace knows the whitespace of _SPACE
            (inner if p[:1].isspace() and not p[-1:].isspace() else outer).append(p)
        for at in range(0, len(outer), _OUTER):
            part = outer[at : at + _OUTER]
            alone = self._ids([p.decode() for p in part])
            sizes = np.array([len(x) for x in alone], dtype=np.int64)
            self._remember(part, np.fromiter(chain.from_iterable(alone), dtype=self.type, count=int(sizes.sum())), sizes)
        for at in range(0, len(inner), _INNER):
            part = inner[at : at + _INNER]
            ids = np.array(self._ids([b"".join(part).decode()])[0], dtype=self.type)
            ends = np.cumsum(list(map(len, part)))
            self._remember(part, ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends, side="right"), prepend=0))

    def _encode_parted(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        space = _SPACE[raw]
        cut = np.zeros(len(raw), dtype=bool)
        cut[1:] = space[1:] & ~space[:-1] | _PUNCT[raw[1:]] & _ALNUM[raw[:-1]]
        cut[begins[lengths > 0]] = True
        offsets = np.concatenate([np.flatnonzero(cut), [len(raw)]]).astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        # Through an object array: a list of Arrow's own makes a scalar of each piece first.
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > self.room:
            self._make_room()
        found = list(map(self.known.get, distinct))
        new = [i for i, number in enumerate(found) if number is None]
        if new:
            self._learn([distinct[i] for i in new])
            for i in new:
                found[i] = self.known[distinct[i]]
        indices = pieces.indices.to_numpy()
        found = np.array(found, dtype=np.int64)
        self.hits[found] += np.bincount(indices, minlength=len(found))
        numbers = found[indices]
        start, size = self.places[numbers].T
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        # Tokens before each text: those of the pieces that begin before it.
        tokens = np.concatenate([[0], np.cumsum(size)])
        borders = tokens[np.searchsorted(offsets[:-1], np.concatenate([begins, [len(raw)]]), side="left")]
        return [ids[a:b] for a, b in zip(borders, borders[1:])]

    def _stretches(self, raw: bytes) -> Iterator[bytes]:
        """A text in stretches of about ``_BATCH`` bytes that end where a piece does."""
        at = 0
        while at < len(raw):
            stop = at + _BATCH
            while stop < len(raw):
                space = _SPACE[np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(stop + 1, len(raw)) - at)]
                cuts = np.flatnonzero(space[1:] & ~space[:-1])
                if len(cuts):
                    stop = at + int(cuts[-1]) + 1
                    break
                stop += _BATCH
            yield raw[at:stop]
            at = stop

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, dtype=self.type)] * len(texts)
        held: list[tuple[int, bytes]] = []
        n = 0

        def flush() -> None:
            if held:
                for (i, _), ids in zip(held, self._encode_parted([raw for _, raw in held])):
                    out[i] = ids
                held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode()
            if not self.parted or any(x in raw for x in _WHOLE):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type)
                continue
            if len(raw) > _BATCH:
                out[i] = np.concatenate([self._encode_parted([x])[0] for x in self._stretches(raw)])
                continue
            if n + len(raw) > _BATCH:
                flush()
                n = 0
            held.append((i, raw))
            n += len(raw)
        flush()
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_json: str) -> PieceEncoder:
    """The encoder of a worker, kept from task to task."""
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = PieceEncoder(tokenizer_json)
    return _ENCODERS[name]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; raw content of the samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_store(docs: DataFrame, path: str, tokenizer_json: str, key: str = "doc_id", text: str = "text",
                end_id: int = END_ID) -> None:
    """Encode every text, append the end id and write the store in ascending order of the key.

    A null text is empty. Repeated rows are documents of their own; null keys come first.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    # The sample: the documents with the smallest hashes of their keys.
    order = F.xxhash64("key")
    least = rows.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first().h

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.append(ids, np.array(end_id, dtype=ids.dtype)).tobytes()[:SAMPLE_BYTES]
                for ids in _encoder(sent.value).encode(batch.column(0).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    chosen = rows.where(order <= F.lit(least)).limit(2 * SAMPLE_DOCS) if least is not None else rows.limit(0)
    samples = sorted(r.ids for r in chosen.select("text").mapInArrow(serialise, "ids binary").collect())
    content = train_dictionary(samples)
    dict_hash = hashlib.sha256(content).hexdigest()
    trained = spark.sparkContext.broadcast(content)
    width = PieceEncoder(tokenizer_json).type.itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained.value)).compress
        end = np.array([end_id], dtype=encoder.type)
        block = row = token = 0
        frames: list[bytes] = []
        keys: list = []
        counts: list[int] = []
        part = 0

        def full() -> pa.RecordBatch:
            offsets = [0, *accumulate(map(len, frames))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([row], pa.int64()),
                    pa.array([token], pa.int64()), pa.array([dict_hash]),
                    pa.array([next((k for k in keys if k is not None), None)], kind), pa.array([keys[-1]], kind), pa.array([keys], pa.list_(kind)),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([b"".join(frames)], pa.binary()),
                ],
                ["part", "block", "first_row", "first_token", "dict_hash", "low", "high", "keys", "n_tokens",
                 "offsets", "payload"],
            )

        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            # Some rows at a time, so that the ids of a batch are never held together.
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                for k, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    frames.append(compress(ids.tobytes()))
                    keys.append(k)
                    counts.append(len(ids))
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES:
                        yield full()
                        block, row, token, size = block + 1, row + len(keys), token + sum(counts), 0
                        frames, keys, counts = [], [], []
        if frames:
            yield full()

    of = docs.schema[key].dataType.simpleString()
    schema = (
        f"part int, block int, first_row bigint, first_token bigint, dict_hash string, low {of}, high {of}, "
        f"keys array<{of}>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
    )
    placed = rows.orderBy("key").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(pack, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(
        [(dict_hash, bytearray(content), width, end_id)], "dict_hash string, dictionary binary, width int, end_id int"
    ).coalesce(1).write.parquet(f"{path}/meta")

    # One row per part; their sums run through the driver.
    total = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = (
        spark.read.parquet(f"{path}/blocks").groupBy("part")
        .agg(F.sum(F.size("keys")).alias("rows"), F.sum(total).alias("tokens")).orderBy("part").collect()
    )
    before = list(zip((r.part for r in sums), accumulate([0, *(r.rows for r in sums)]), accumulate([0, *(r.tokens for r in sums)])))
    spark.createDataFrame(before, "part int, rows_before bigint, tokens_before bigint").coalesce(1).write.parquet(
        f"{path}/parts"
    )


def _opener(spark: SparkSession, path: str):
    """Reads a frame of the store at ``path`` back to its ids."""
    meta = spark.read.parquet(f"{path}/meta").first()
    kind, dict_hash, content = np.dtype(f"<u{meta.width}"), meta.dict_hash, bytes(meta.dictionary)
    if hashlib.sha256(content).hexdigest() != dict_hash:
        raise ValueError("token store: the dictionary does not have its hash")
    sent = spark.sparkContext.broadcast(content)

    def opener():
        decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(sent.value)).decompress

        def read(frame: bytes, named: str) -> np.ndarray:
            if named != dict_hash:
                raise ValueError("token store: a block names another dictionary")
            return np.frombuffer(decompress(frame), dtype=kind)

        return read

    return opener


def read_store(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``key, row, start, n_tokens, ids_crc32`` and ``ids`` of every document, from its frame.

    ``start`` is the number of ids of all documents before it; the checksum is that of
    the ids as little-endian unsigned 32-bit integers.
    """
    opener = _opener(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").select(
        "part", "first_row", "first_token", "dict_hash", "keys", "n_tokens", "offsets", "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = opener()
        for batch in batches:
            for i in range(batch.num_rows):
                part, row, token, named, keys, counts, offsets, payload = (c[i].as_py() for c in batch.columns)
                starts = list(accumulate(counts, initial=token))[:-1]
                crcs, all_ids = [], []
                for n, a, b in zip(counts, offsets, offsets[1:]):
                    ids = read(payload[a:b], named).astype("<u4")
                    if len(ids) != n:
                        raise ValueError("token store: a frame does not have its length")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [
                    pa.array([part] * len(keys), pa.int32()), pa.array(range(row, row + len(keys)), pa.int64()),
                    pa.array(starts, pa.int64()), batch.column(4)[i].values, pa.array(counts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["part", "row", "start", "key", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    of = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"part int, row bigint, start bigint, key {of}, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    parts = spark.read.parquet(f"{path}/parts")
    found = blocks.mapInArrow(run, schema).join(parts, "part")
    return found.select(
        F.col("key").alias(key), (F.col("row") + F.col("rows_before")).alias("row"),
        (F.col("start") + F.col("tokens_before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids,
    )


def read_document(spark: SparkSession, path: str, key) -> list[list[int]]:
    """The ids of the documents with one key: only their blocks are read, only their frames opened."""
    read = _opener(spark, path)()
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("low") <= F.lit(key)) & (F.col("high") >= F.lit(key)))
    at = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.get("keys", i) == F.lit(key))
    frames = blocks.select("part", "block", "dict_hash", "offsets", "payload", F.posexplode(at).alias("i", "at")).select(
        "part", "block", "at", "dict_hash",
        F.substring(
            F.col("payload"), F.get("offsets", F.col("at")).cast("int") + 1,
            (F.get("offsets", F.col("at") + 1) - F.get("offsets", F.col("at"))).cast("int"),
        ).alias("frame"),
    )
    found = sorted(frames.toLocalIterator(), key=lambda r: (r.part, r.block, r.at))
    return [read(bytes(r.frame), r.dict_hash).tolist() for r in found]
