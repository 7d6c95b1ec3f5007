"""Grams of texts in Arrow batches: code points as integers, cut and weighed many at a time.

Tasks get whole batches of texts; Spark deals the texts and adds up what tasks give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_SIZE = 3  # code points of a gram that fit one integer
STEP = 1 << 21  # code points that are cut at a time
DENSE = 1 << 23  # places of a table that is read by position instead of searched
_BITS = 21
_POINTS = 0x110000
_END = 0xD800  # follows each text; no text holds a lone surrogate
_END_TEXT = chr(_END)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text followed by an end, and where each begins. A null is an empty text."""
    read = [b.decode("utf-8", "replace") if b else "" for b in texts.cast(pa.large_binary()).to_pylist()]
    whole = "".join([x + _END_TEXT for x in read]).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(read), np.int64)
    np.cumsum([len(x) + 1 for x in read[:-1]], out=starts[1:])
    return np.frombuffer(whole, "<u4"), starts


def windows(codes: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of bounded length, ``first, last`` and their codes with those that a gram from within may reach."""
    for first in range(0, len(codes), STEP):
        last = min(first + STEP, len(codes))
        reach = np.full(last - first + size - 1, _END, np.uint32)
        found = codes[first : last + size - 1]
        reach[: len(found)] = found
        yield first, last, reach


def cut_counts(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct cuts, as integers, and their numbers: the longest gram at each position, shorter at the end of a text."""
    codes, _ = codes_of(texts)
    for first, last, reach in windows(codes, size):
        points = np.where(reach == _END, 0, reach.astype(np.int64) + 1)
        n = last - first
        keys = at = points[:n]
        for j in range(1, size):
            at = np.where(at == 0, 0, points[j : n + j])
            keys = (keys << _BITS) | at
        cuts, counts = np.unique(keys[points[:n] > 0], return_counts=True)
        if len(cuts):
            yield cuts, counts


def cut_texts(cuts: np.ndarray, size: int) -> pa.Array:
    """The texts of cuts given as integers."""
    shifts = np.arange(size - 1, -1, -1, dtype=np.int64) * _BITS
    points = (cuts[:, None] >> shifts) & ((1 << _BITS) - 1)
    codes = points - 1
    width = np.where(points == 0, 0, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    ends = np.concatenate([[0], np.cumsum(width.sum(axis=1))]).astype(np.int64)
    data = codes[points > 0].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).cast(pa.string())


def counted_cuts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per batch of ``lang, text`` and language the distinct cuts and their numbers: ``lang, cut, n``."""
    for batch in batches:
        coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
        order = np.asarray(coded.indices)
        for i in range(len(coded.dictionary)):
            value = coded.dictionary.slice(i, 1)
            for cuts, counts in cut_counts(batch.column(1).filter(pa.array(order == i)), size):
                lang = value.take(pa.array(np.zeros(len(cuts), np.int64)))
                yield pa.RecordBatch.from_arrays([lang, cut_texts(cuts, size), pa.array(counts, pa.int64())], ["lang", "cut", "n"])


class GramWeights:
    """Weights of grams as a tree of prefixes in arrays.

    Each node holds the sums over its own gram and those that begin it: the number of grams with
    weights, then the weights of each column. So a text takes one row per position, that of the longest prefix
    in the tree.
    """

    def __init__(self, grams: pa.Array, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_columns: int):
        """``rows``, ``columns`` and ``weights`` are the entries: number of the gram, number of the column, weight."""
        codes, starts = codes_of(grams)
        lengths = np.diff(np.append(starts, len(codes))) - 1
        self.alphabet = np.unique(codes[codes != _END])
        self.size = int(lengths.max(initial=1))
        letters = self._letters()[codes].astype(np.int64)
        own, node = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        self.levels, self.firsts, parents = [], [0], [np.zeros(1, np.int64)]
        n_nodes = 1
        for j in range(self.size):
            long = lengths > j
            # Ranks within a level count from 1; 0 is no node.
            keys = node[long] * (len(self.alphabet) + 1) + letters[starts[long] + j]
            level, rank = np.unique(keys, return_inverse=True)
            node = np.where(long, 0, node)
            node[long] = rank + 1
            parents.append(level // (len(self.alphabet) + 1) + (self.firsts[-1] if j else 0))
            self.levels.append(level)
            self.firsts.append(n_nodes - 1)
            own[lengths == j + 1] = node[lengths == j + 1] + n_nodes - 1
            n_nodes += len(level)
        self.firsts = self.firsts[1:]
        self.sums = np.zeros((n_columns + 1, n_nodes))
        self.sums[0, own] = 1.0
        np.add.at(self.sums, (columns + 1, own[rows]), weights)
        for parent, first in zip(parents[2:], self.firsts[1:]):
            self.sums[:, first + 1 : first + 1 + len(parent)] += self.sums[:, parent]

    def _letters(self) -> np.ndarray:
        numbers = np.zeros(_POINTS, np.int32)
        numbers[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return numbers

    def _ranks(self, level: int):
        """What finds the rank of a node by its key, 0 if there is none."""
        keys = self.levels[level]
        places = (len(self.levels[level - 1]) + 1 if level else 1) * (len(self.alphabet) + 1)
        if places <= DENSE:
            table = np.zeros(places, np.int32)
            table[keys] = np.arange(1, len(keys) + 1)
            return lambda asked: table[asked]

        def search(asked: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[at] == asked, at + 1, 0) if len(keys) else np.zeros_like(asked)

        return search

    def reader(self):
        """A function from texts to their sums, one row per column of ``sums``."""
        letters, finders = self._letters(), [self._ranks(j) for j in range(len(self.levels))]

        def read(texts: pa.Array) -> np.ndarray:
            codes, starts = codes_of(texts)
            out = np.zeros((len(self.sums), len(starts)))
            for first, last, reach in windows(codes, self.size):
                n = last - first
                own = letters[reach]
                rank = node = np.zeros(n, np.int64)
                for j, find in enumerate(finders):
                    # No node has the key of an unknown prefix or letter.
                    rank = find(rank.astype(np.int64) * (len(self.alphabet) + 1) + own[j : n + j])
                    node = np.where(rank > 0, rank + self.firsts[j], node)
                low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "left")
                cuts = np.maximum(starts[low:high], first) - first
                for k, column in enumerate(self.sums):
                    out[k, low:high] += np.add.reduceat(column[node], cuts)
            return out

        return read
