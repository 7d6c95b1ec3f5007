"""Fill-in-the-middle documents: prefix, suffix and middle of a text in another order.

A text is cut into units (a word with the whitespace before it, or whitespace at the end),
and two borders between units are drawn from a hash of the key. To find them, a Fenwick
tree over fixed blocks of the text's bytes holds the units that end and the code points
that begin in each block; a binary-lifting descent finds the block of a border, and the
border itself is looked for in that block only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 4096
SEED = 42
PERCENT = 50  # of the texts are rearranged,
SPM_PERCENT = 80  # and of those so many with the suffix first

# The marks before prefix, suffix and middle. No mark ends as another one begins.
MARKS = ("<P>", "<S>", "<M>")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLICE_BYTES = 1 << 22
_OUT_BYTES = 1 << 24


class BlockTree:
    """Fenwick tree over the blocks of one text: units that end, and code points that begin, in each."""

    def __init__(self, raw: bytes, block_bytes: int = BLOCK_BYTES):
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.block = block_bytes
        blocks = -(-len(raw) // block_bytes)
        counts = np.zeros((blocks + 1, 2), dtype=np.int64)
        step = max(1, _SLICE_BYTES // block_bytes)
        for at in range(0, blocks, step):
            low, high = at * block_bytes, min(len(raw), (at + step) * block_bytes)
            starts = np.arange(0, high - low, block_bytes)
            for column, marked in enumerate((self._ends(low, high), self._begins(low, high))):
                counts[at + 1 : at + 1 + len(starts), column] = np.add.reduceat(marked, starts, dtype=np.int64)
        upto = np.cumsum(counts, axis=0)
        node = np.arange(blocks + 1)
        self.tree = upto - upto[node - (node & -node)]
        self.tree[0] = 0
        self.units, self.chars = upto[-1].tolist()

    def _ends(self, low: int, high: int) -> np.ndarray:
        """Whether a unit ends with a byte: a word before whitespace, or the end of the text."""
        space = _SPACE[self.data[low : high + 1]]
        if high < len(self.data):
            return space[1:] & ~space[:-1]
        ends = np.ones(high - low, dtype=bool)
        ends[:-1] = space[1:] & ~space[:-1]
        return ends

    def _begins(self, low: int, high: int) -> np.ndarray:
        """Whether a code point begins with a byte."""
        return (self.data[low:high] & 0xC0) != 0x80

    def border(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if not units:
            return 0, 0
        block = chars = 0
        left = units
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            ahead = block + step
            if ahead < len(self.tree) and self.tree[ahead, 0] < left:
                block = ahead
                left -= int(self.tree[ahead, 0])
                chars += int(self.tree[ahead, 1])
            step >>= 1
        low, high = block * self.block, min(len(self.data), (block + 1) * self.block)
        stop = low + int(np.flatnonzero(self._ends(low, high))[left - 1]) + 1
        return stop, chars + int(self._begins(low, stop).sum())


def draws(key, seed: int = SEED) -> list[int]:
    """Four numbers from the hash of a key; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: str | None, key, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT):
    """Number of units, form, code points of prefix and of middle, and the output for one text.

    The form is ``plain`` where the text stays as it is: it is empty, it contains a mark,
    or the draw leaves it.
    """
    text = text or ""
    raw = text.encode()
    tree = BlockTree(raw)
    n = tree.units
    one, two, chance, order = draws(key, seed)
    if not text or any(m in text for m in MARKS) or chance % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    (a, a_chars), (b, b_chars) = tree.border(low), tree.border(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = (x.encode() for x in MARKS)
    form = "spm" if order % 100 < spm_percent else "psm"
    parts = [s, suffix, p, prefix] if form == "spm" else [p, prefix, s, suffix]
    return n, form, a_chars, b_chars - a_chars, b"".join([*parts, m, middle]).decode()


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, percent: int = PERCENT,
                spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every whole text.

    ``n`` counts the units. A null text is empty: no units, plain, output ``''``. Plain texts
    have null for the two lengths. A null key draws like an empty one; rows that repeat
    have equal results; an empty table gives an empty one. Other columns are not read. A text without
    whitespace is one unit, so its borders are its ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["_key", "n", "form", "prefix_chars", "middle_chars", "output"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            held, size = [], 0

            def full() -> pa.RecordBatch:
                columns = zip(*held) if held else [[]] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

            for k, t in zip(batch.column(0), batch.column(1)):
                own = k.as_py()
                found = rearranged(t.as_py(), own, seed, percent, spm_percent)
                held.append((own, *found))
                size += len(found[-1])
                if size > _OUT_BYTES:
                    yield full()
                    held, size = [], 0
            yield full()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    made = rows.mapInArrow(
        run, f"_key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )
    return made.select(F.col("_key").alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(MARKS))
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )
