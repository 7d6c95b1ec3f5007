"""Exact dedup of arriving batches against immutable snapshots of digests.

1. A batch is digested (SHA-256 of the whole text) and grouped by digest: copies within
   the batch become one row each before anything else happens.
2. Each earlier snapshot holds its digests in buckets, and a static binary-fuse filter per
   bucket (9 bits a digest, 1 in 256 wrong positives). The digests of the batch go to the
   buckets, meet the filter first, and only positives join the exact digests.
3. Digests that no snapshot holds become the next snapshot; those that one holds are
   written beside it as seen again. Snapshots are never changed.
4. Digests with more than one row have their texts compared byte by byte. Should texts
   differ under one digest, their rows are grouped by the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moodmill.llm.common import beside, by_key, durable, whole_runs
from moodmill.session import scratch_path

BATCHES = 3
BUCKET_DIGESTS = 1 << 18  # aimed at; buckets are even, since digests are
SCREEN_BYTES = 64 << 20  # the filter of repeated digests is sent to the tasks up to this size

_U = np.uint64


class FuseFilter:
    """Static three-wise binary-fuse filter with one byte a cell, over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    def _places(self, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The three cells of each key, in segments that follow each other, and its mark."""
        h = keys + _U(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        h ^= h >> _U(31)
        first = ((h >> _U(32)) * _U(self.segment * self.count)) >> _U(32)
        within = _U(self.segment - 1)
        second = (first + _U(self.segment)) ^ ((h >> _U(18)) & within)
        third = (first + _U(2 * self.segment)) ^ (h & within)
        return [x.astype(np.int64) for x in (first, second, third)], (h ^ (h >> _U(32))).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> FuseFilter:
        """A filter that holds all keys; repeated ones count once."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        segment = 1 << min(18, max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
        cells = math.ceil(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        count = max(1, math.ceil(cells / segment) - 2)
        for seed in range(1, 1000):
            made = cls(seed, segment, count, np.zeros((count + 2) * segment, dtype=np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError("binary-fuse filter: no seed fits")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel cells that one key is left in, round by round; then set them in reverse."""
        places, mark = self._places(keys)
        size = len(self.cells)
        number = np.arange(len(keys))
        load = sum(np.bincount(p, minlength=size) for p in places)
        total = np.zeros(size, dtype=np.int64)  # sum of the numbers of the keys in a cell
        for p in places:
            np.add.at(total, p, number)
        rounds, left = [], len(keys)
        alone = np.flatnonzero(load == 1)
        while len(alone):
            who, at = np.unique(total[alone], return_index=True)
            rounds.append((who, alone[at]))
            left -= len(who)
            touched = np.concatenate([p[who] for p in places])
            np.subtract.at(load, touched, 1)
            np.subtract.at(total, touched, np.tile(who, 3))
            alone = np.unique(touched[load[touched] == 1])
        if left:
            return False
        for who, cell in reversed(rounds):
            a, b, c = (self.cells[p[who]] for p in places)
            self.cells[cell] = mark[who] ^ a ^ b ^ c  # the own cell is still zero
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter, and for about 1 in 256 of others."""
        places, mark = self._places(keys.astype(np.uint64))
        a, b, c = (self.cells[p] for p in places)
        return (a ^ b ^ c) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], dtype="<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, content: bytes) -> FuseFilter:
        seed, segment, count = np.frombuffer(content[:24], dtype="<i8").tolist()
        return cls(seed, segment, count, np.frombuffer(content[24:], dtype=np.uint8))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filters(digests: DataFrame) -> DataFrame:
    """``bucket, filter``: one binary-fuse filter per bucket of ``bucket, h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["bucket"], rows=BUCKET_DIGESTS):
            bucket, h = table.column("bucket").to_numpy(), table.column("h").to_numpy()
            for own in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                made = FuseFilter.of(h[own].view(np.uint64)).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int64()), pa.array([made])], ["bucket", "filter"])

    placed = digests.select("bucket", "h").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, "bucket bigint, filter binary")


def screened(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``bucket, h, digest`` that the filter of their bucket lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for bucket, part in by_key(batches, "bucket"):
            sides = part.column("side").to_numpy(zero_copy_only=False)
            if sides[0]:
                held, own = bucket, FuseFilter.from_bytes(part.column("filter")[0].as_py())
            rows = part.filter(pa.array(~sides)).select(["bucket", "h", "digest"])
            if rows.num_rows and held == bucket:
                yield rows.filter(pa.array(own.holds(rows.column("h").to_numpy().view(np.uint64))))

    return beside(digests.select("bucket", "h", "digest"), filters, "bucket").mapInArrow(
        run, "bucket bigint, h bigint, digest binary"
    )


class DigestStore:
    """Snapshots of digests in a folder; each is written once and then only read."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """Without a path the store is a new folder; with one its finished snapshots are found there."""
        self.spark, self.path = spark, path or scratch_path(spark, "digests")
        self.buckets: list[int] = []
        while path and self._finished(len(self.buckets)):
            self.buckets.append(self.spark.read.parquet(f"{self._at(len(self.buckets))}/meta").first().buckets)

    def _at(self, number: int) -> str:
        return f"{self.path}/{number:06d}"

    def _finished(self, number: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(number)}/meta/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def known(self, digests: DataFrame) -> DataFrame | None:
        """The digests that a snapshot holds; None if there is no snapshot."""
        found = None
        for number, buckets in enumerate(self.buckets):
            at = self._at(number)
            placed = digests.withColumn("bucket", F.pmod("h", F.lit(buckets)))
            positive = screened(placed, self.spark.read.parquet(f"{at}/filters"))
            exact = self.spark.read.parquet(f"{at}/digests").select("bucket", "digest")
            held = positive.join(exact, ["bucket", "digest"], "left_semi").select("digest")
            found = held if found is None else found.unionByName(held)
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """Write the batch of distinct ``digest`` rows as the next snapshot; returns all its rows.

        Rows whose digest an earlier snapshot holds are written as seen again, the others
        make the snapshot with its filters. The last table written marks it as finished.
        """
        at, number = self._at(len(self.buckets)), len(self.buckets)
        rows = durable(batch.withColumn("h", F.xxhash64("digest")), "batch")
        buckets = max(1, -(-rows.count() // BUCKET_DIGESTS))
        placed = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
        known = self.known(rows)
        if known is not None:
            known = durable(known.distinct(), "known")
            rows.join(known, "digest", "left_semi").write.mode("overwrite").parquet(f"{at}/again")
            placed = placed.join(known, "digest", "left_anti")
        placed.write.mode("overwrite").parquet(f"{at}/digests")
        new = self.spark.read.parquet(f"{at}/digests")
        filters(new).write.mode("overwrite").parquet(f"{at}/filters")
        self.spark.range(1).select(F.lit(number).alias("number"), F.lit(buckets).cast("long").alias("buckets")).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{at}/meta")
        self.buckets.append(buckets)
        return self.rows(number)

    def rows(self, number: int) -> DataFrame:
        """The distinct digests of one batch with their columns, new ones and those seen again."""
        at = self._at(number)
        new = self.spark.read.parquet(f"{at}/digests").drop("bucket", "h")
        return new.unionByName(self.spark.read.parquet(f"{at}/again").drop("h")) if number else new


def _merged(rows: DataFrame, n: Column, key: str, row: str) -> DataFrame:
    """One row per digest: number of rows, largest key, and a row that has it; by partial sums."""
    return rows.groupBy("digest").agg(
        n.alias("n"), F.max(key).alias("keep"), F.coalesce(F.max_by(row, key), F.min(row)).alias("keep_row")
    )


def _screen(keys: DataFrame, most_bytes: int) -> Callable[[Column], Column] | None:
    """A column that is true for the keys ``h`` and few others, if its filters are within the bound."""
    n = keys.count()
    if n * 1.25 > most_bytes:
        return None
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    rows = filters(keys.withColumn("bucket", F.pmod("h", F.lit(buckets)))).collect()
    sent = keys.sparkSession.sparkContext.broadcast({r.bucket: bytes(r.filter) for r in rows})
    opened: dict[int, FuseFilter] = {}

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        own = h.to_numpy().astype(np.int64)
        at = own % buckets
        out = np.zeros(len(own), dtype=bool)
        for b in np.unique(at):
            if b in sent.value:
                if b not in opened:
                    opened[b] = FuseFilter.from_bytes(sent.value[b])
                out[at == b] = opened[b].holds(own[at == b].view(np.uint64))
        return pd.Series(out)

    return maybe


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES,
                 digest: Callable[[Column], Column] = sha256, store: DigestStore | None = None,
                 screen_bytes: int = SCREEN_BYTES) -> DataFrame:
    """``key, keep_id, group_size, kept, digest`` of every row: copies are rows of equal whole texts.

    The row with the largest key stays; of several rows with it, one. A null key is less
    than any other, and a group of null keys keeps one row with ``keep_id`` null. A null text
    equals an empty one. An empty table gives an empty one. Columns beside key and text are not read.

    ``docs`` arrives in ``batches`` parts, dealt by a hash of the key and the place of the row;
    their number does not change the result. A store that is given goes on from its snapshots,
    whose groups are those of this table only if the store is new. Up to ``screen_bytes`` a
    filter of the repeated digests keeps other texts out of the byte comparison; beyond, all take
    part in it.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = durable(
        docs.select(F.col(f"`{key}`").alias("key"), digest(whole).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digested",
    )
    store = store or DigestStore(spark)
    arrival = F.pmod(F.xxhash64("key", "row"), F.lit(batches))
    parts = [
        store.add(_merged(rows.where(arrival == b), F.count("*"), "key", "row")) for b in range(batches)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    classes = durable(_merged(every, F.sum("n"), "keep", "keep_row").where("n > 1"), "repeated")

    # Byte checks: only texts whose digest is repeated are compared, one of each text and task.
    texts = docs.select(whole.alias("text"), digest(whole).alias("digest"))
    maybe = _screen(classes.select(F.xxhash64("digest").alias("h")), screen_bytes)
    suspects = texts if maybe is None else texts.where(maybe(F.xxhash64("digest")))
    distinct = suspects.groupBy("digest", "text").agg(F.count("*").alias("n"))
    unlike = durable(distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "unlike")

    same = rows.join(classes, "digest", "left").select(
        "key",
        F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "digest",
    )
    if not unlike.isEmpty():
        # Different texts under one digest: these rows are grouped by the text itself.
        mixed = durable(
            docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), digest(whole).alias("digest"))
            .join(unlike, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()),
            "mixed",
        )
        apart = durable(
            mixed.groupBy("digest", "text").agg(
                F.count("*").alias("n"), F.max("key").alias("keep"),
                F.coalesce(F.max_by("row", "key"), F.min("row")).alias("keep_row"),
            ),
            "apart",
        )
        same = same.join(unlike, "digest", "left_anti").unionByName(
            mixed.join(apart, ["digest", "text"]).select(
                "key", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
                (F.col("row") == F.col("keep_row")).alias("kept"), "digest",
            )
        )
    return same.select(F.col("key").alias(key), "keep_id", "group_size", "kept", "digest")
