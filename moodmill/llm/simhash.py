"""SimHash near-duplicates by bit-sliced comparison.

1. Each text gets a 64-bit fingerprint of its word shingles (one pass, a row at a time).
2. Equal fingerprints become one row, so that copies never meet each other.
3. Pigeonhole: with radius r the 64 bits are cut into r + m blocks; two fingerprints
   within r bits agree in m blocks at least. Each choice of m blocks is a table, its
   bits a bucket. m grows with the number of fingerprints so that buckets stay small;
   every m gives the same links.
4. In a bucket, bit planes are stored vertically: one 64-bit word holds one bit of 64
   fingerprints. A query adds its differences to all 64 by carry-save counters of three
   bits and an overflow bit; words all of whose lanes have overflowed are abandoned.
5. A bucket gives a forest of at most one link per member, not its pairs. Buckets over
   a bound are split into cells of two parts each, so no task holds a hot bucket.
6. Links become components by large-star and small-star rounds on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from moodmill.llm.common import durable, whole_runs

# Fixed values of the fingerprint.
SEED = 42
SHINGLE_WORDS = 4
BITS = 64
RADIUS = 4
MOST_RADIUS = 7  # three bits count the differences

BUCKET_ROWS = 2048  # aimed at by the number of blocks
CELL_ROWS = 4096  # at most in one part of a split bucket
_CHUNK = 1 << 18
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    if not text:
        return 0
    # bytes.lower changes A-Z only; bytes.split cuts at exactly 0x20 and 0x09-0x0D.
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes)
    begin = (ends - sizes)[: len(found) - words + 1].tolist()
    end = (ends - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end)], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, fp bigint").select(
        F.col("key").alias(key), "fp"
    )


def block_tables(n: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """The bit masks of the tables: every pair within the radius agrees under one of them.

    64 bits in r + m blocks, m of which are chosen. m is the least with which evenly
    spread fingerprints fill buckets of at most ``bucket_rows`` rows.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the counters of the comparison hold a radius of 0 to {MOST_RADIUS}")
    for agree in range(1, BITS - radius):
        blocks = radius + agree
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
        narrow = sum(sorted(b - a for a, b in zip(cuts, cuts[1:]))[:agree])
        if n / 2**narrow <= bucket_rows or agree == 4:
            return [sum(chosen) for chosen in combinations(masks, agree)]
    raise AssertionError("four blocks always do")


def _planes(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack the prints of each group (0, 1, ...; sorted) into words of 64 lanes.

    Returns the planes (64 x words), the lanes in use of each word, and the number of
    words of each group.
    """
    sizes = np.bincount(group)
    words = (sizes + 63) // 64
    first_row, first_word = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    within = np.arange(len(prints)) - first_row[group]
    slot = first_word[group] * 64 + within
    laid = np.zeros(int(words.sum()) * 64, dtype=np.uint64)
    used = np.zeros(len(laid), dtype=np.uint8)
    laid[slot], used[slot] = prints, 1
    bits = np.unpackbits(laid.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    vertical = np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(vertical).view("<u8").reshape(64, -1)
    return planes, np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel(), words


def _near(planes: np.ndarray, used: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int):
    """For pairs of a word and a query print: the pairs that have a hit, and their lanes as bits."""
    at = np.arange(len(word))
    c0 = np.zeros(len(word), dtype=np.uint64)
    c1, c2 = c0.copy(), c0.copy()
    over = ~used[word]
    start = 7 - radius  # counters begin there, so that the eighth overflows past the radius
    for bit, counter in enumerate((c0, c1, c2)):
        if start >> bit & 1:
            counter[:] = _FULL
    one = np.uint64(1)
    for j in range(64):
        differs = planes[j][word] ^ (np.uint64(0) - ((query >> np.uint64(j)) & one))
        carry = c0 & differs
        c0 ^= differs
        differs = c1 & carry
        c1 ^= carry
        carry = c2 & differs
        c2 ^= differs
        over |= carry
        if j % 8 == 7:
            alive = over != _FULL
            if not alive.all():
                at, word, query, c0, c1, c2, over = (x[alive] for x in (at, word, query, c0, c1, c2, over))
            if not len(at):
                break
    return at, ~over


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the members a[i] and b[i]: labels end as the least index of each set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _absorb(prints: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Take dense families out of one large group; returns the rows that are left.

    A few rows spread over the group are tried as seeds. One that is near to many is
    followed to the end of its component, and each of its rows is compared only with
    what is left, so a family costs little more than one pass.
    """
    left = np.arange(len(prints))
    for seed in np.unique(np.linspace(0, len(prints) - 1, 48).astype(np.int64)):
        if len(left) < 512 or not (left == seed).any():
            continue
        queue = np.array([seed])
        rest = left[left != seed]
        first = True
        while len(queue) and len(rest):
            now, queue = queue[:64], queue[64:]
            planes, used, words = _planes(prints[rest], np.zeros(len(rest), dtype=np.int64))
            word = np.tile(np.arange(words[0]), len(now))
            query = np.repeat(prints[now], words[0])
            at, lanes = _near(planes, used, word, query, radius)
            hit = np.zeros(words[0], dtype=np.uint64)
            np.bitwise_or.at(hit, word[at], lanes)
            found = np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(rest)].astype(bool)
            if first and found.sum() * 32 < len(rest):
                break
            first = False
            _hook(label, np.full(int(found.sum()), seed), rest[found])
            queue, rest = np.concatenate([queue, rest[found]]), rest[~found]
        if not first:
            left = rest  # the component is complete, or nothing is left to compare
    return left


def linked(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each print the index of the first one of its component within its group."""
    label = np.arange(len(prints))
    sizes = np.bincount(group)
    keep = np.ones(len(prints), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > 1024):
        rows = slice(starts[g], starts[g] + sizes[g])
        own = np.arange(sizes[g])
        left = _absorb(prints[rows], own, radius)
        label[rows] = own + starts[g]
        keep[rows] = False
        keep[starts[g] + left] = True
    rows = np.flatnonzero(keep)
    if not len(rows):
        return label
    _, group = np.unique(group[rows], return_inverse=True)
    own = prints[rows]
    planes, used, words = _planes(own, group)
    sizes = np.bincount(group)
    first_row, first_word = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    per_row = words[group]
    upto = np.cumsum(per_row)
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _CHUNK, side="right")))
        counts = per_row[at:stop]
        who = np.repeat(np.arange(at, stop), counts)
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        word = first_word[group[who]] + step
        hit, lanes = _near(planes, used, word, own[who], radius)
        for part in range(0, len(hit), 1 << 14):
            pair, lane = np.nonzero(
                np.unpackbits(lanes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            )
            pair = hit[part : part + (1 << 14)][pair]
            a = who[pair]
            b = first_row[group[a]] + (word[pair] - first_word[group[a]]) * 64 + lane
            apart = a < b
            _hook(label, rows[a[apart]], rows[b[apart]])
        at = stop
    return label


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links ``a > b`` between distinct fingerprints ``fp`` that make the same components as all pairs."""
    masks = block_tables(n, radius)
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias(
            "table", "bucket"
        ),
    )
    # Buckets above the bound: at most tables x fingerprints / CELL_ROWS of them.
    large = durable(
        keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "simhash-large"
    )
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(0)) / F.lit(CELL_ROWS)).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.greatest(parts, F.lit(1))).cast("int")
    other = F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)
    cells = (
        keyed.join(large, ["table", "bucket"], "left")
        .withColumn("part", part)
        .select("fp", "table", "bucket", "part", F.explode(other).alias("other"))
        .select(
            "fp", "table", "bucket",
            F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        )
    )
    keys = ["table", "bucket", "low", "high"]
    placed = cells.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, keys):
            values = [table.column(k).to_numpy() for k in keys]
            own = table.column("fp").to_numpy().view(np.uint64)
            new = np.ones(len(own), dtype=bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
            label = linked(own, np.cumsum(new) - 1, radius)
            away = label != np.arange(len(own))
            a, b = own[away].view(np.int64), own[label[away]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root``: the least node reachable over edges ``a > b``; only nodes with an edge.

    Large-star and small-star steps in turn until the edges are stars. Each round is a
    written table, so a lost executor costs one step; the joins are plain equi-joins of
    written tables, whose hot nodes adaptive execution splits.
    """
    edges = durable(edges.select("a", "b"), "edges")
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u moves to the least of u and its neighbours.
        least = durable(edges.groupBy("a").agg(F.min("b").alias("to")), "least")
        via = edges.join(least.withColumnRenamed("a", "b"), "b", "left").select(
            F.col("a"), F.coalesce("to", "b").alias("b")
        )
        large = durable(via.distinct(), "large-star")
        # Small star: u and its smaller neighbours meet at the least of them.
        small_least = durable(large.groupBy("a").agg(F.min("b").alias("to"), F.count("*").alias("n")), "small-least")
        moved = large.join(small_least, "a").where(F.col("b") != F.col("to")).select(F.col("b").alias("a"), F.col("to").alias("b"))
        after = durable(small_least.select("a", F.col("to").alias("b")).unionByName(moved).distinct(), "small-star")
        # Stars: no node both has a root and is one, and no node has two.
        done = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and moved.isEmpty()
        edges = after
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components: too many rounds")


def _rooted(marked: DataFrame, key: str, radius: int) -> DataFrame:
    """``fp, _root, _first`` of each distinct ``fp``: the component it belongs to and its least key."""
    reps = durable(marked.groupBy("fp").agg(F.min(key).alias("_first")), "prints")
    roots = components(links(reps.select("fp"), reps.count(), radius))
    return durable(
        reps.join(roots, reps["fp"] == roots["node"], "left").select(
            reps["fp"], F.coalesce("root", reps["fp"]).alias("_root"), "_first"
        ),
        "rooted",
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """``key, fp, component_id``: the smallest key of the documents reachable over links.

    Null and empty texts have fingerprint zero, which links like any other. A repeated
    row is linked to itself. Rows with a null key are in the result with the component
    of the others; an empty table gives an empty one.
    """
    marked = durable(with_fingerprint(docs, key, text, words), "fingerprints")
    placed = _rooted(marked, key, radius)
    lowest = durable(placed.groupBy("_root").agg(F.min("_first").alias("component_id")), "lowest")
    named = durable(placed.join(lowest, "_root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def _row_hash(columns: list[str], seed: int) -> Column:
    """A hash of a whole row; the nulls count with their places."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols])


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                  radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, the one with the smallest key and hash of the whole row.

    The columns are those of ``docs``. Of repeated rows one stays; different texts under
    one key are judged like those of different keys. Rows without a key do not stand for
    rows with one: each group has one of its own for them.
    """
    names = docs.columns
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.struct(
            F.col(f"`{key}`").alias("key"), _row_hash(names, 1).alias("a"), _row_hash(names, 2).alias("b")
        ).alias("_id"),
        F.col(f"`{text}`").alias("_text"),
    )
    marked = durable(with_fingerprint(boxed, "_id", "_text", words), "fingerprints")
    placed = marked.join(_rooted(marked, "_id", radius).select("fp", "_root"), "fp")
    chosen = placed.groupBy("_root", F.col("_id.key").isNull()).agg(F.min("_id").alias("_best"))
    chosen = durable(chosen.select("_best.a", "_best.b"), "chosen")
    # The two hashes stand for the row, so that a key with many rows is spread; equal rows become one.
    named = boxed.select("_row", "_id.a", "_id.b").join(chosen, ["a", "b"], "left_semi")
    return named.groupBy("a", "b").agg(F.first("_row").alias("_row")).select("_row.*")


def fingerprint_hex(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
