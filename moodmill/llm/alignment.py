"""Alignment of two tokenizers: which tokens of one stand where tokens of the other stand.

Tokenizer A is byte-level, B has pieces with a mark for the space; both are read over the
same bytes, a space and the text. Byte offsets at which a token of A and one of B end cut
the text into groups, and every token of A in a group is linked with every token of B in it.

1. Pass one aligns all documents. A part (a run of rows of the written input) gives its
   distinct pairs of ids with the number of its documents that hold them linked.
2. The distinct pairs of the corpus are dealt to segments by hash. Each segment gets a
   minimal perfect hash; keys are kept in its order, so that every index is verified.
3. Counts of the parts are added up in dense vectors indexed by that hash, first within
   lanes of parts, then over the lanes.
4. The parts' pairs meet the vectors and carry the counts of the corpus back to the parts.
   Pass two aligns the documents of a part again, beside the counts that it needs.

Both tokenizers end a token wherever a space follows something that is not whitespace, so
texts are aligned unit by unit there and a unit that comes again is looked up. Where that
border is not certain (Unicode whitespace, the mark itself) no unit ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from moodmill.llm.common import beside, by_key, byte_alphabet, durable, whole_runs

PART_ROWS = 4096
SEGMENT_ROWS = 1 << 17  # rows of parts that a segment aims at
LANES = 4
CACHE_BYTES = 64 << 20  # what a worker remembers of units
_SLICE = 1 << 21  # bytes of text in hand
_LEARN = 1 << 18  # bytes of new units encoded at a time
_LINKS = 1 << 21  # links laid out at a time
_UNIT_BYTES = 330  # a remembered unit beside its own bytes, groups and pairs

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_SPACES = _SPACE.tolist()
_MARK = "▁"
# Whitespace beyond ASCII and the mark of tokenizer B, in UTF-8 as whole numbers.
_UNSURE = np.array([
    int.from_bytes(chr(c).encode(), "big")
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, ord(_MARK))
])
# Fixed value: how byte-level tokenizers part a text before they merge.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOGETHER = 100  # units encoded as one text
_U = np.uint64


@dataclass
class Units:
    """Some units in turn: counts per unit, the ids of their groups, their distinct pairs with numbers of links."""

    counts: np.ndarray  # n x 4: tokens of A, of B, groups, links
    text: list[bytes]
    n_pairs: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(alphabet.get, n)) if all(c in alphabet for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_text = [str(i) for i in range(size)]
        self.b_text = [str(i) for i in range(len(pieces))]
        cut = json.loads(a_json)
        pre = cut.get("pre_tokenizer") or {}
        # Other tokenizers may look across a space.
        self.parted = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not cut.get("normalizer") and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        )
        # Where ids are numbered in the order of the merges, they are the ranks of a faster encoder of the same kind.
        model = cut.get("model", {})
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges") or []]
        vocab = model.get("vocab", {})
        self.quick = None
        if self.parted and merges and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))):
            ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
            self.quick = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for units, each of which begins with a space; None where either does not give back the bytes."""
        texts = [b"".join(units[i : i + _TOGETHER]).decode() for i in range(0, len(units), _TOGETHER)]
        if self.quick:
            found = map(self.quick.encode_ordinary, texts)
        else:
            found = (self.a.encode(t, add_special_tokens=False).ids for t in texts)
        a = list(chain.from_iterable(found))
        b = list(chain.from_iterable(self.b.encode([t[1:] for t in texts], num_threads=1)))
        data = b"".join(units)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Where units begin within some bytes, beside their beginning."""
        if not self.parted or len(raw) < 2:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero((raw[1:] == 32) & ~_SPACE[raw[:-1]]) + 1
        wide = np.flatnonzero(raw[at - 1] >= 0x80)
        if len(wide):
            last = at[wide] - 1
            two = raw[last - 1].astype(np.int64) << 8 | raw[last]
            three = raw[np.maximum(last - 2, 0)].astype(np.int64) << 16 | two
            at = np.delete(at, wide[np.isin(two, _UNSURE) | np.isin(three, _UNSURE)])
        return at

    def align(self, units: list[bytes], ids: tuple[np.ndarray, np.ndarray], texts: bool = True) -> Units | None:
        """The units, given the ids of all of them in turn; None if the tokens of one do not end with it."""
        a, b = ids
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        stop = np.cumsum([len(u) for u in units])
        # A mark for each byte at which a token of both ends; the marks before a byte number its group.
        end, other = np.zeros(int(stop[-1]) + 1, dtype=bool), np.zeros(int(stop[-1]) + 1, dtype=bool)
        end[a_end], other[b_end] = True, True
        end &= other
        if not end[stop].all():
            return None
        common, before = np.flatnonzero(end), np.cumsum(end) - end
        n, groups = len(units), len(common)
        n_a = np.bincount(before[a_end], minlength=groups)
        n_b = np.bincount(before[b_end], minlength=groups)
        owner = np.searchsorted(stop, common)
        first = np.searchsorted(owner, np.arange(n + 1))
        counts = np.add.reduceat(np.stack([n_a, n_b, np.ones_like(n_a), n_a * n_b], axis=1), first[:-1], axis=0)
        a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        text = [b""] * n
        if texts:
            sa = list(map(self.a_text.__getitem__, a.tolist()))
            sb = list(map(self.b_text.__getitem__, b.tolist()))
            said = [
                f"{sa[i]}|{sb[j]}" if x == 1 == y else f"{','.join(sa[i : i + x])}|{','.join(sb[j : j + y])}"
                for i, x, j, y in zip(a_at.tolist(), n_a.tolist(), b_at.tolist(), n_b.tolist())
            ]
            at = first.tolist()
            text = [";".join(said[i:j]).encode() if j - i > 1 else said[i].encode() for i, j in zip(at, at[1:])]
        # Links, a bounded number at a time; a unit's pairs are made distinct with their numbers.
        found = []
        for low, high in _runs(n_a * n_b, _LINKS):
            if high - low == 1 and n_a[low] * n_b[low] > _LINKS:
                pair, links = _product(a[a_at[low] : a_at[low] + n_a[low]], b[b_at[low] : b_at[low] + n_b[low]])
                found.append((np.full(len(pair), owner[low]), pair, links))
                continue
            y = n_b[low:high]
            size = n_a[low:high] * y
            group = np.repeat(np.arange(high - low), size)
            within = np.arange(len(group)) - (np.cumsum(size) - size)[group]
            row = within // y[group]
            pair = a[a_at[low:high][group] + row] << 32 | b[b_at[low:high][group] + within - row * y[group]]
            found.append(_distinct(owner[low:high][group], pair, np.ones(len(pair), dtype=np.int64)))
        unit, pairs, links = found[0] if len(found) == 1 else _distinct(*(np.concatenate(x) for x in zip(*found)))
        return Units(counts, text, np.bincount(unit, minlength=n), pairs, links)


def _distinct(unit: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal unit and pair as one, in the order of units."""
    order = np.lexsort((pair, unit))
    unit, pair, links = unit[order], pair[order], links[order]
    new = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])])
    return unit[new], pair[new], np.add.reduceat(links, new)


def _runs(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose weights sum to at most ``most``, or of one row."""
    upto = np.cumsum(weights)
    low = 0
    while low < len(weights):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of one large group and their links."""
    (a, x), (b, y) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] << 32 | b).ravel(), (x[:, None] * y).ravel()


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their numbers."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys, numbers = (np.concatenate(x) for x in zip(*parts))
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, place, numbers)
    return distinct, total


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches laid one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Aligner:
    """Aligns texts and remembers their units in arrays, up to a number of bytes; the most used ones stay."""

    def __init__(self, pair: Pair, room: int = CACHE_BYTES, texts: bool = True):
        self.pair, self.room, self.texts = pair, room, texts
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.held = self.used = 0
        # Per unit: tokens of A, of B, groups, links; a place for two sums; start and number of its pairs.
        self.counts = np.zeros((1 << 12, 4), dtype=np.int64)
        self.sums = np.full((1 << 12, 2), -1, dtype=np.int64)
        self.places = np.zeros((1 << 12, 2), dtype=np.int64)
        self.hits = np.zeros(1 << 12, dtype=np.int64)
        self.wrong = np.zeros(1 << 12, dtype=bool)  # does not give back its bytes
        self.pairs = np.zeros(1 << 14, dtype=np.int64)
        self.links = np.zeros(1 << 14, dtype=np.int64)

    def _keep(self, units: list[bytes], found: Units, wrong: bool = False) -> None:
        n, m = len(self.known), len(found.pairs)
        while n + len(units) > len(self.hits):
            for name, empty in (("counts", 0), ("sums", -1), ("places", 0), ("hits", 0), ("wrong", False)):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.full_like(own, empty)]))
        while self.used + m > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        rows = slice(n, n + len(units))
        self.counts[rows], self.sums[rows], self.hits[rows], self.wrong[rows] = found.counts, -1, 0, wrong
        self.places[rows, 0] = self.used + np.cumsum(found.n_pairs) - found.n_pairs
        self.places[rows, 1] = found.n_pairs
        self.pairs[self.used : self.used + m], self.links[self.used : self.used + m] = found.pairs, found.links
        self.used += m
        self.known.update(zip(units, range(n, n + len(units))))
        self.text += found.text
        self.held += _UNIT_BYTES * len(units) + 16 * m + sum(map(len, units)) + sum(map(len, found.text))

    def _make_room(self) -> None:
        """Drop the less used half of the units; the counts of use of the others are halved, so that they can age."""
        n = len(self.known)
        keep = np.zeros(n, dtype=bool)
        keep[np.argsort(-self.hits[:n], kind="stable")[: n // 2]] = True
        units = [u for u, k in zip(self.known, keep.tolist()) if k]
        at = spread(*self.places[:n][keep].T)
        found = Units(
            self.counts[:n][keep], [t for t, k in zip(self.text, keep.tolist()) if k], self.places[:n, 1][keep],
            self.pairs[at], self.links[at],
        )
        sums, hits, wrong = self.sums[:n][keep], self.hits[:n][keep] // 2, self.wrong[:n][keep]
        self._forget()
        self._keep(units, found)
        rows = slice(0, len(units))
        self.sums[rows], self.hits[rows], self.wrong[rows] = sums, hits, wrong

    def _alone(self, unit: bytes) -> None:
        ids = self.pair.encode([unit])
        none = np.zeros(0, dtype=np.int64)
        found = Units(np.zeros((1, 4), dtype=np.int64), [b""], np.zeros(1, dtype=np.int64), none, none)
        self._keep([unit], found if ids is None else self.pair.align([unit], ids, self.texts), wrong=ids is None)

    def _learn(self, units: list[bytes]) -> None:
        """Align new units. Those that end in something sure go as one text, which both tokenizers part again."""
        sure, size = [], 0

        def flush() -> None:
            if not sure:
                return
            ids = self.pair.encode(sure)
            found = None if ids is None else self.pair.align(sure, ids, self.texts)
            if found is None:
                for unit in sure:
                    self._alone(unit)
            else:
                self._keep(sure, found)
            sure.clear()

        for unit in units:
            last = unit[-1]
            if not self.pair.parted or _SPACES[last] or last >= 0x80 and ((c := unit.decode()[-1]).isspace() or c == _MARK):
                self._alone(unit)
                continue
            sure.append(unit)
            size += len(unit)
            if size > _LEARN:
                flush()
                size = 0
        flush()

    def _numbers(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units of some texts laid one after the other, and the borders of the texts among them.

        Numbers hold until the next call.
        """
        if self.held > self.room:
            self._make_room()
        raw = np.frombuffer(data, dtype=np.uint8)
        begins = np.zeros(len(raw), dtype=bool)
        begins[self.pair.cuts(raw)] = True
        begins[starts] = True
        at = np.flatnonzero(begins)
        offsets = np.concatenate([at, [len(raw)]]).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(self.known.get, distinct))
        new = [i for i, number in enumerate(numbers) if number is None]
        if new:
            self._learn([distinct[i] for i in new])
            for i in new:
                numbers[i] = self.known[distinct[i]]
        found = np.array(numbers, dtype=np.int64)
        indices = units.indices.to_numpy()
        self.hits[found] += np.bincount(indices, minlength=len(found))
        return found[indices], np.searchsorted(at, np.append(starts, len(raw)))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Rows, the numbers of their units, and the borders of the rows among them; to be used before the next step.

        A row with a long text comes several times, alone. Rows without tokens do not come.
        """
        held: list[tuple[int, bytes]] = []
        size = 0

        def whole(row: int, data: bytes) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
            # A unit does not give back its bytes; the whole text decides.
            if data not in self.known:
                self._alone(data)
            number = self.known[data]
            if not self.wrong[number]:
                yield [row], np.array([number]), np.array([0, 1])

        def several() -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
            if not held:
                return
            lengths = np.array([len(d) for _, d in held])
            numbers, borders = self._numbers(b"".join([d for _, d in held]), np.cumsum(lengths) - lengths)
            bad = np.add.reduceat(self.wrong[numbers], borders[:-1], dtype=np.int64) > 0
            if not bad.any():
                yield [i for i, _ in held], numbers, borders
                return
            sizes = np.diff(borders)
            good = np.repeat(~bad, sizes)
            yield [i for (i, _), b in zip(held, bad) if not b], numbers[good], np.concatenate([[0], np.cumsum(sizes[~bad])])
            for (row, data), b in zip(held, bad):
                if b:
                    yield from whole(row, data)

        for row, text in enumerate(texts):
            if not text:
                continue
            data = b" " + text.encode()
            if len(data) > _SLICE:
                yield from several()
                held, size = [], 0
                yield from self._long(row, data, whole)
                continue
            if size + len(data) > _SLICE:
                yield from several()
                held, size = [], 0
            held.append((row, data))
            size += len(data)
        yield from several()

    def _long(self, row: int, data: bytes, whole) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        at = np.concatenate([[0], self.pair.cuts(np.frombuffer(data, dtype=np.uint8)), [len(data)]])
        pieces = [(int(at[low]), int(at[high])) for low, high in _runs(np.diff(at), _SLICE)]
        for checked in (False, True):
            for a, b in pieces:
                numbers, borders = self._numbers(data[a:b], np.zeros(1, dtype=np.int64))
                if self.wrong[numbers].any():
                    yield from whole(row, data)
                    return
                if checked:
                    yield [row], numbers, borders


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each key where it is alone.

    A key that shares its place of a level goes on to the next one. The index of a key is
    the number of bits before its own. Keys that were not given get an index or -1; the caller verifies.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return (((h ^ (h >> _U(31))) >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left):
            size = max(8, 2 * len(left))
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
            if len(sizes) > 200:
                raise ValueError("perfect hash: keys are not distinct")
        return cls(sizes, np.concatenate(levels).astype(np.uint8) if levels else np.zeros(0, dtype=np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            place = base + self._place(keys[open_], level, size)
            hit = self.bits[place] == 1
            out[open_[hit]] = self.before[place[hit]]
            open_ = open_[~hit]
            base += size
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], dtype="<i8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, content: bytes) -> PerfectHash:
        levels = int(np.frombuffer(content[:8], dtype="<i8")[0])
        sizes = np.frombuffer(content[8 : 8 + 8 * levels], dtype="<i8").tolist()
        bits = np.unpackbits(np.frombuffer(content[8 + 8 * levels :], dtype=np.uint8), count=sum(sizes))
        return cls(sizes, bits)


class Table:
    """A segment: a perfect hash, the keys in its order, and a vector of counts."""

    def __init__(self, row: pa.RecordBatch):
        self.hash = PerfectHash.from_bytes(row.column("hash")[0].as_py())
        self.keys = np.frombuffer(row.column("keys")[0].as_py(), dtype="<i8")
        counts = row.column("counts")[0].as_py() if "counts" in row.schema.names else None
        self.counts = np.zeros(len(self.keys), dtype=np.int64) if counts is None else np.frombuffer(counts, dtype="<i8")

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The verified index of each key."""
        at = self.hash.index(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise ValueError("alignment: a pair is not in its segment")
        return at


_PAIRS: dict[str, Pair] = {}


def _pair(a_json: str, b_model: bytes) -> Pair:
    """The tokenizers of a worker, kept from task to task."""
    name = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if name not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[name] = Pair(a_json, b_model)
    return _PAIRS[name]


def _batch(columns: dict[str, tuple[np.ndarray | list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns.values()], list(columns))


def some_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``_SLICE`` bytes of text at a time, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in _runs(sizes, _SLICE):
        yield batch.slice(a, b - a)


def documents_with(aligner: Aligner, numbers: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some documents and how many of these documents hold each."""
    units, place = np.unique(numbers, return_inverse=True)
    start, size = aligner.places[units].T
    pairs, local = np.unique(aligner.pairs[spread(start, size)], return_inverse=True)
    before = np.cumsum(size) - size
    flat = local[spread(before[place], size[place])]
    ends = np.concatenate([[0], np.cumsum(size[place])])[borders].tolist()
    # Within a document the last writer of a pair is the one that counts.
    writer, order = np.zeros(len(pairs), dtype=np.int64), np.arange(len(flat))
    n = np.zeros(len(pairs), dtype=np.int64)
    for a, b in zip(ends, ends[1:]):
        own = flat[a:b]
        writer[own] = order[a:b]
        n[own[writer[own] == order[a:b]]] += 1
    return pairs, n


def part_pairs(parts: DataFrame, sent) -> DataFrame:
    """``part, pair, n``: the distinct linked pairs of each part, with the number of its documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_pair(*sent.value), texts=False)
        held, size, own = [], 0, None

        def full() -> pa.RecordBatch:
            pairs, n = summed(held)
            held.clear()
            return _batch({"part": (np.full(len(pairs), own), pa.int64()), "pair": (pairs, pa.int64()), "n": (n, pa.int64())})

        for part, rows in by_key(batches, "part"):
            if own is not None and part != own:
                yield full()
                size = 0
            own = part
            long: dict[int, np.ndarray] = {}
            for some in some_rows(rows):
                long.clear()
                for who, numbers, borders in aligner.documents(some.column("text").to_pylist()):
                    pairs, n = documents_with(aligner, numbers, borders)
                    if len(who) == 1:
                        long[who[0]] = np.union1d(long.get(who[0], pairs), pairs)
                        continue
                    held.append((pairs, n))
                    size += len(pairs)
                    if size > 1 << 20:
                        held[:] = [summed(held)]
                        size = 0
                held += [(pairs, np.ones(len(pairs), dtype=np.int64)) for pairs in long.values()]
        if own is not None:
            yield full()

    return parts.select("part", "text").mapInArrow(run, "part bigint, pair bigint, n bigint")


def perfect_hashes(pairs: DataFrame) -> DataFrame:
    """``segment, hash, keys``: the minimal perfect hash of the distinct pairs of each segment, and the pairs in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["segment"], rows=SEGMENT_ROWS):
            segment, pair = table.column("segment").to_numpy(), table.column("pair").to_numpy()
            for own in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(segment)) + 1):
                made = PerfectHash.of(pair[own])
                keys = np.zeros(len(own), dtype="<i8")
                keys[made.index(pair[own])] = pair[own]
                yield _batch({
                    "segment": ([segment[own[0]]], pa.int64()), "hash": ([made.to_bytes()], pa.binary()),
                    "keys": ([keys.tobytes()], pa.binary()),
                })

    placed = pairs.select("segment", "pair").distinct().repartition("segment").sortWithinPartitions("segment")
    return placed.mapInArrow(run, "segment bigint, hash binary, keys binary")


def lane_vectors(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``segment, counts``: for each lane of parts the dense vector of the segment's counts."""
    lane = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    sides = hashes.select("segment", "hash", "keys", lane).withColumn("cell", F.col("segment") * LANES + F.col("lane"))
    rows = pairs.select((F.col("segment") * LANES + F.pmod("part", F.lit(LANES))).alias("cell"), "pair", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = None, None

        def full() -> pa.RecordBatch:
            return _batch({"segment": ([own // LANES], pa.int64()), "counts": ([table.counts.tobytes()], pa.binary())})

        for cell, part in by_key(batches, "cell"):
            side = part.column("side").to_numpy(zero_copy_only=False)
            if side[0]:
                if table is not None and table.counts.any():
                    yield full()
                own, table = cell, Table(part.slice(0, 1))
            rows = part.filter(pa.array(~side))
            if rows.num_rows:
                np.add.at(table.counts, table.index(rows.column("pair").to_numpy()), rows.column("n").to_numpy())
        if table is not None and table.counts.any():
            yield full()

    return beside(rows, sides.drop("segment", "lane"), "cell").mapInArrow(run, "segment bigint, counts binary")


def segment_counts(hashes: DataFrame, lanes: DataFrame) -> DataFrame:
    """``segment, hash, keys, counts``: the sums of the vectors of all lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, row = None, None, None

        def full() -> pa.RecordBatch:
            return _batch({
                "segment": ([own], pa.int64()), "hash": ([row.column("hash")[0].as_py()], pa.binary()),
                "keys": ([row.column("keys")[0].as_py()], pa.binary()), "counts": ([table.counts.tobytes()], pa.binary()),
            })

        for segment, part in by_key(batches, "segment"):
            for i, side in enumerate(part.column("side").to_pylist()):
                if side:
                    if own is not None:
                        yield full()
                    own, row = segment, part.slice(i, 1)
                    table = Table(row.select(["hash", "keys"]))
                else:
                    table.counts += np.frombuffer(part.column("counts")[i].as_py(), dtype="<i8")
        if own is not None:
            yield full()

    return beside(lanes, hashes, "segment").mapInArrow(run, "segment bigint, hash binary, keys binary, counts binary")


def highest(counts: DataFrame) -> DataFrame:
    """``a, best``: the highest count of each id of A; a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column(0)[i].as_py(), dtype="<i8") >> 32
                n = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i8")
                ids, place = np.unique(a, return_inverse=True)
                most = np.zeros(len(ids), dtype=np.int64)
                np.maximum.at(most, place, n)
                yield _batch({"a": (ids, pa.int64()), "best": (most, pa.int64())})

    found = counts.select("keys", "counts").mapInArrow(run, "a bigint, best bigint")
    return found.groupBy("a").agg(F.max("best").alias("best"))


def looked_up(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``part, pair, n``: the pairs of each part with their counts in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for _, part in by_key(batches, "segment"):
            side = part.column("side").to_numpy(zero_copy_only=False)
            if side[0]:
                table = Table(part.slice(0, 1))
            rows = part.filter(pa.array(~side))
            if rows.num_rows:
                found = table.counts[table.index(rows.column("pair").to_numpy())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("part"), rows.column("pair"), pa.array(found, pa.int64())], ["part", "pair", "n"]
                )

    return beside(pairs.select("segment", "part", "pair"), counts, "segment").mapInArrow(
        run, "part bigint, pair bigint, n bigint"
    )


def aligned_parts(parts: DataFrame, counted: DataFrame, sent, kind: str) -> DataFrame:
    """Pass two: the documents of each part, aligned again beside the counts ``part, count_of, n, best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_pair(*sent.value))
        own, fresh = None, []
        keys = counts = best = None

        def sums(numbers: np.ndarray) -> np.ndarray:
            """Links at the highest count, and the sum of counts, of each unit; they are the same in every part."""
            new = np.unique(numbers[aligner.sums[numbers, 0] < 0])
            if len(new):
                start, size = aligner.places[new].T
                flat = spread(start, size)
                pairs, links = aligner.pairs[flat], aligner.links[flat]
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                if (keys[at] != pairs).any():
                    raise ValueError("alignment: a pair has no count")
                both = np.stack([links * best[at], links * counts[at]], axis=1)
                aligner.sums[new] = np.add.reduceat(both, np.cumsum(size) - size, axis=0)
            return aligner.sums[numbers]

        for part, rows in by_key(batches, "part"):
            if part != own:
                own, fresh = part, []
            side = rows.column("side").to_numpy(zero_copy_only=False)
            if side[0]:
                some = rows.filter(pa.array(side))
                fresh.append([some.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
            docs = rows.filter(pa.array(~side))
            if not docs.num_rows:
                continue
            if fresh:
                keys, counts, best = (np.concatenate(x) for x in zip(*fresh))
                keys, first = np.unique(keys, return_index=True)
                counts, best, fresh = counts[first].astype(np.int64), best[first].astype(np.int64), []
            for some in some_rows(docs):
                total = np.zeros((some.num_rows, 6), dtype=np.int64)
                said: list[list[bytes]] = [[] for _ in range(some.num_rows)]
                for who, numbers, borders in aligner.documents(some.column("text").to_pylist()):
                    each = np.concatenate([aligner.counts[numbers], sums(numbers)], axis=1)
                    total[who] += np.add.reduceat(each, borders[:-1], axis=0)
                    text = list(map(aligner.text.__getitem__, numbers.tolist()))
                    for i, a, b in zip(who, borders.tolist(), borders[1:].tolist()):
                        said[i].append(b";".join(text[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [some.column("key"), *[pa.array(c) for c in total.T],
                     pa.array([b";".join(x).decode() for x in said], pa.string())],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    return beside(parts, counted, "part").mapInArrow(
        run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    )


def pair_counts(counts: DataFrame) -> DataFrame:
    """``a, b, n``: the table of the corpus, a row per linked pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = np.frombuffer(batch.column(0)[i].as_py(), dtype="<i8")
                n = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i8")
                yield _batch({"a": (pair >> 32, pa.int64()), "b": (pair & 0xFFFFFFFF, pa.int64()), "n": (n, pa.int64())})

    return counts.select("keys", "counts").mapInArrow(run, "a bigint, b bigint, n bigint")


def aligned(docs: DataFrame, a_json: str, b_model: bytes, key: str = "doc_id", text: str = "text",
            part_rows: int = PART_ROWS, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Every document aligned, and the counts of the corpus.

    The first frame has a row per row of ``docs``: ``key, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``; ``groups`` reads ``a1,a2|b1;a3|b2,b3`` in ids. The second is
    read by ``pair_counts``: in how many documents a pair of ids is linked. ``n_best`` counts
    the links whose pair has the highest count of its id of A (ties included), ``count_sum``
    adds up the counts over the links.

    A text that is null or empty, or that either tokenizer does not give back byte by byte,
    has no tokens: zeros and empty groups. Repeated rows count as documents of their own.
    Null keys are kept; an empty table gives empty frames; other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((a_json, b_model))  # two vocabularies of fixed size
    kind = docs.schema[key].dataType.simpleString()
    # Row numbers of the written table deal the parts, so that no key or copy makes one large.
    at = F.monotonically_increasing_id()
    numbered = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), at.alias("at"))
    parts = durable(
        numbered.select(
            "key", "text",
            (F.shiftright("at", 33) * (1 << 20) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / part_rows)).alias("part"),
        ),
        "parts",
    )
    pairs = durable(part_pairs(parts, sent), "part-pairs")
    segments = max(1, -(-pairs.count() // segment_rows))
    pairs = pairs.withColumn("segment", F.pmod(F.xxhash64("pair"), F.lit(segments)))
    hashes = durable(perfect_hashes(pairs), "hashes")
    counts = durable(segment_counts(hashes, lane_vectors(pairs, hashes)), "counts")
    # At most a row for each id of the vocabulary of A.
    best = F.broadcast(highest(counts))
    counted = looked_up(pairs, counts).withColumn("a", F.shiftright("pair", 32)).join(best, "a").select(
        "part", "pair", "n", (F.col("n") == F.col("best")).alias("best")
    )
    found = aligned_parts(parts, counted, sent, kind).withColumnRenamed("key", key)
    return found, counts
