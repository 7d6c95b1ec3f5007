"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark items are normalised to words and put into one suffix automaton. The
words of a document are streamed through it, tracking the longest match that ends at
each word. A match of at least the window length ends an occurrence of a window; the
state whose strings have just that length names the items. Items shorter than a window
are windows as a whole.

The benchmark is read in blocks of a bounded number of words, each with an automaton of
its own that is sent to the tasks. The documents meet one block after the other, written
in between, so neither the driver nor a task ever holds more than one automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from moodmill.llm.common import durable

# The length of a window and the bytes that part words.
WINDOW = 10
_TABLE = bytes(
    32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b
    for b in range(256)
)

BLOCK_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all other characters beyond ASCII; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Suffix automaton of several word sequences with the items of each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        sequences = []
        for name, words in items:
            if words:
                sequence = [self.ids.setdefault(w, len(self.ids)) for w in words]
                sequences.append((name, sequence))
                last = 0
                for word in sequence:
                    last = self._extend(last, word)
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        self.names: list[str] = [name for name, _ in sequences]
        self.hits: dict[int, list[tuple[int, list[int]]]] = {}
        self._name_windows([s for _, s in sequences])

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            same = self.length[target] == self.length[at] + 1
            self.link[new] = target if same else self._split(at, target, word)
        return new

    def _state(self, steps: dict[int, int], length: int, link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, target: int, word: int) -> int:
        copy = self._state(dict(self.next[target]), self.length[at] + 1, self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and the length of the longest match after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def _holder(self, state: int, length: int) -> int:
        """The state on the suffix path whose strings include the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _name_windows(self, sequences: list[list[int]]) -> None:
        found: dict[tuple[int, int], dict[int, None]] = {}
        for item, sequence in enumerate(sequences):
            size = min(self.window, len(sequence))
            state = length = 0
            for i, word in enumerate(sequence):
                state, length = self.step(state, length, word)
                if i + 1 >= size:
                    found.setdefault((self._holder(state, size), size), {})[item] = None
        for (state, size), items in found.items():
            self.hits.setdefault(state, []).append((size, list(items)))

    def ends(self, sequence: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """For a sequence of word ids: end position, window length and items of each occurrence."""
        state = length = 0
        for i, word in enumerate(sequence):
            state, length = self.step(state, length, word)
            if length < self.shortest:
                continue
            # Only states whose strings are as long as a window can hold one.
            at = self._holder(state, self.window) if length >= self.window else state
            while at > 0:
                for size, items in self.hits.get(at, ()):
                    if size <= length:
                        yield i, size, items
                at = self.link[at]
                if self.length[at] < self.shortest:
                    break

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans ``[start, end)`` of words inside windows, and the names of the items."""
        if len(words) < self.shortest:
            return [], set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        # A window lies within a stretch of known words that is as long as the shortest one.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            for i, size, named in self.ends(ids[a:b].tolist()):
                items.update(named)
                low, high = a + i + 1 - size, a + i + 1
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, high))
        return spans, {self.names[i] for i in items}


def automata(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW,
             block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of the benchmark, one per block of items and one at least; items without a word take no part."""
    held, n, first = [], 0, True
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        words = words_of(row[1])
        held.append((row[0] or "", words))
        n += len(words)
        if n >= block_words:
            yield SuffixAutomaton(held, window)
            held, n = [], 0
            first = False
    if held or first:
        yield SuffixAutomaton(held, window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, window: int, block_words: int) -> DataFrame:
    """``row, text, n_words, items, spans`` of every row of ``docs``, after all blocks of the benchmark."""
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"),
    )
    schema = found.schema
    for number, automaton in enumerate(automata(benchmark, window=window, block_words=block_words)):
        if number:
            found = durable(found, "searched")
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, items, spans = [], [], []
                for t, had_items, had_spans in zip(batch.column(1), batch.column(3), batch.column(4)):
                    words = words_of(t.as_py())
                    here, named = sent.value.search(words)
                    n_words.append(len(words))
                    items.append(sorted(named.union(had_items.as_py())))
                    before = [(s["start"], s["end"]) for s in had_spans.as_py()]
                    spans.append([{"start": a, "end": b} for a, b in merged(here + before)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                     pa.array(items, batch.schema.field(3).type), pa.array(spans, batch.schema.field(4).type)],
                    schema=batch.schema,
                )

        found = found.mapInArrow(run, schema)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, spans``; spans are word positions ``[start, end)``.

    Null and empty texts have no words; repeated rows give repeated results. An empty
    benchmark hits nothing.
    """
    found = _searched(docs.select(F.col(key).alias("key"), text), benchmark, text, window, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("row.key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "spans",
    )


def items_digest(items: list[str]) -> str:
    """Digest of the sorted item ids, joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2], raw


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    begin, end, raw = _word_bounds(text)
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : begin[a]])
        at = end[b - 1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  max_span: int = WINDOW, max_coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark passages; the columns are those of ``docs``.

    Spans of at least ``max_span`` words are cut from the text. A document of whose words
    more than ``max_coverage`` lie in windows is removed; with 0 every contaminated one
    is, with 1 all stay without their spans. Clean rows pass unchanged, also null texts.
    """
    names = docs.columns
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    found = _searched(docs, benchmark, text, window, block_words)
    kept = found.where(hit <= max_coverage * F.col("n_words")).select(
        "row", "text", F.filter("spans", lambda s: s["end"] - s["start"] >= max_span).alias("spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, spans in enumerate(batch.column(2).to_pylist()):
                if spans:
                    texts[i] = cut_spans(texts[i], [(s["start"], s["end"]) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    if max_coverage > 0:
        kept = kept.mapInArrow(run, T.StructType([kept.schema["row"], kept.schema["text"]]))
    # Without any coverage allowed nothing is left to cut.
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names])
