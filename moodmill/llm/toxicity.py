"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reporting verb, other. A first
transducer looks ahead: it writes a trigger word with a mark if a target follows it
closely. The next writes events: an insult, or a threat whose mark says that it reaches a
target. Further ones read what that one wrote and mark events that follow a target, a
negation, or a reporting verb. They are composed into one machine; an arc that writes an
event carries its context and the weight of that: kind, whether directed, negated and
reported. The weight of an event is that of its lexicon entry plus that of its arc, both
log-odds learned from labelled rows and drawn to a prior where rare. The score of a text is
logistic in the weights of its events.

The insult lexicon is learned: words and word beginnings that occur in toxic rows far
more often than in others, by a binomial test at a fixed level, next to a few fixed entries that labels can outweigh. Threat words stay threats, whatever
their learned weight is. The fit uses a bounded sample of the labelled rows; scoring runs
over all texts, whole, in time that grows with their length. Triggers are found by one
automaton over the text, and only their clauses are parsed.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from moodmill.llm.common import durable

FIT_ROWS = 30_000  # labelled rows of which the model is fitted, at most
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
MIN_ROWS = 3  # toxic rows that hold an entry, at least
MIN_LOG_ODDS = 3.0
LEVEL = 2e-4  # of the binomial test of an entry
MOST_COUNTED = 5
CONTEXT_PRIOR_ROWS = 10.0

# Word lists in English, German, French and Spanish.
INSULTS = """idiot moron stupid loser scum trash worthless pathetic disgusting imbecile
dummkopf trottel abschaum widerlich salaud ordure minable imbécile basura escoria patético asqueroso""".split()
THREATS = """kill hurt destroy beat smash crush shoot töten vernichten schlagen erschießen
tuer frapper détruire écraser matar golpear destruir aplastar""".split()
TARGETS = """you your yours u he she they them him her these those people du dich dir ihr euch er sie
tu toi vous il elle ils elles te ustedes vosotros él ella ellos""".split()
NEGATIONS = """not no never n't isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás ningún""".split()
REPORTS = """said says say told claims claimed wrote quoted called sagte sagt schrieb behauptet
dit disait écrit affirme dijo dice escribió afirma""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_TRIGGERS = (INSULT, THREAT)
_THREATS = frozenset(THREATS)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_ENDS = ".!?;:\n"
_CLAUSE_END = re.compile(rf"[{_CLAUSE_ENDS}]")
AHEAD = 3  # words after a trigger in which its target stands

Letter = tuple[int, frozenset]  # a symbol and its marks

# What the look-ahead writes.
LETTERS: tuple[Letter, ...] = (
    *((s, frozenset()) for s in range(6)), *((s, frozenset(["target_after"])) for s in _TRIGGERS),
)


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, letter read) -> (next state, letter written)``; state 0 is the start of a clause."""

    arcs: dict[tuple[int, Letter], tuple[int, Letter]]

    def step(self, state: int, letter: Letter) -> tuple[int, Letter]:
        return self.arcs[state, letter]

    @property
    def reads(self) -> set[Letter]:
        return {letter for _, letter in self.arcs}

    @property
    def writes(self) -> set[Letter]:
        return {letter for _, letter in self.arcs.values()}


def events_of(letters: Iterable[Letter]) -> Transducer:
    """Marks insults, and threats that a target follows."""
    arcs = {}
    for symbol, marks in letters:
        kind = {INSULT: "insult", THREAT: "threat" if "target_after" in marks else None}.get(symbol)
        arcs[0, (symbol, marks)] = (0, (symbol, marks | {kind} if kind else marks))
    return Transducer(arcs)


def after(letters: Iterable[Letter], opener: int, mark: str, reach: int | None = None) -> Transducer:
    """Marks events after an opener, at most ``reach`` words after it if given.

    State 0: none near; state i: the last one is i words back, without a reach always 1.
    """
    arcs = {}
    for state in range((reach or 1) + 1):
        for symbol, marks in letters:
            event = bool(marks & {"insult", "threat"})
            further = (state + 1 if 0 < state < reach else 0) if reach else state
            to = 1 if symbol == opener else further
            arcs[state, (symbol, marks)] = (to, (symbol, marks | {mark} if event and state else marks))
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """One machine that writes what ``b`` writes when it reads what ``a`` writes."""
    numbers, arcs, todo, letters = {(0, 0): 0}, {}, [(0, 0)], a.reads
    while todo:
        pair = todo.pop()
        for letter in letters:
            x, between = a.step(pair[0], letter)
            y, out = b.step(pair[1], between)
            if (x, y) not in numbers:
                numbers[x, y] = len(numbers)
                todo.append((x, y))
            arcs[numbers[pair], letter] = (numbers[x, y], out)
    return Transducer(arcs)


def grammar() -> Transducer:
    """The composed machine over the letters of the look-ahead."""
    machine = events_of(LETTERS)
    for opener, mark, reach in ((TARGET, "target_before", 4), (NEGATION, "negated", 3), (REPORT, "reported", None)):
        machine = compose(machine, after(machine.writes, opener, mark, reach))
    return machine


def context_of(letter: Letter) -> str | None:
    """The context that a written letter stands for; None if it is no event."""
    marks = letter[1]
    kind = marks & {"insult", "threat"}
    if not kind:
        return None
    directed = "directed" if marks & {"target_before", "target_after"} else "plain"
    return "-".join([*kind, directed, *sorted(marks & {"negated", "reported"})])


def looked_ahead(words: Iterable[tuple[int, str]]) -> Iterator[tuple[Letter, str]]:
    """The symbols with their entries as letters: triggers with a target in the next ``AHEAD`` words are marked.

    Each word waits for those words only, so a clause of any length takes bounded memory.
    """
    waiting: deque[list] = deque()
    for symbol, entry in words:
        if symbol == TARGET:
            for held in waiting:
                held[1] = held[0] in _TRIGGERS
        waiting.append([symbol, False, entry])
        if len(waiting) > AHEAD:
            yield _letter(*waiting.popleft())
    while waiting:
        yield _letter(*waiting.popleft())


def _letter(symbol: int, ahead: bool, entry: str) -> tuple[Letter, str]:
    return (symbol, frozenset(["target_after"] if ahead else [])), entry


@dataclass
class Model:
    """Weights of the entries (``word`` or ``beginning*``), of the contexts, and of the logistic score."""

    entries: dict[str, float]
    contexts: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, ...] = (-2.2, 0.3, 0.3, 0.3)

    def __post_init__(self) -> None:
        self._reader = None

    def __getstate__(self):
        return {"entries": self.entries, "contexts": self.contexts, "logistic": self.logistic}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reader = None

    @property
    def reader(self) -> Reader:
        """The automata of this model, built where they are used."""
        if self._reader is None or self._reader.contexts != self.contexts:
            self._reader = Reader(self.entries, self.contexts)
        return self._reader

    def score(self, text: str | None) -> float:
        """Between 0 and 1."""
        found = Counter(weight for _, _, weight in self.reader.matches(text))
        z = self.logistic[0] + sum(b * x for b, x in zip(self.logistic[1:], features(found)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def features(weights: dict[float, int]) -> tuple[float, float, float]:
    """Of events by weight: the greatest weight, the logarithm of the sum, and their number up to a bound."""
    positive = {w: n for w, n in sorted(weights.items()) if w > 0}
    if not positive:
        return 0.0, 0.0, 0.0
    total = math.fsum(w * n for w, n in positive.items())
    return max(positive), math.log1p(total), float(min(MOST_COUNTED, sum(positive.values())))


class Reader:
    """Finds the events of a text."""

    def __init__(self, entries: dict[str, float], contexts: dict[str, float] | None = None):
        self.entries, self.contexts = entries, dict(contexts or {})
        # Arcs with their weights: next state, context written, weight.
        self.arcs = {
            read: (to, context_of(letter), self.contexts.get(context_of(letter), 0.0))
            for read, (to, letter) in grammar().arcs.items()
        }
        self.words = {e for e in entries if not e.endswith("*")}.difference(THREATS)
        self.beginnings = {e[:-1] for e in entries if e.endswith("*")}
        self.lengths = sorted({len(b) for b in self.beginnings}, reverse=True)  # the longest beginning counts
        self.closed = {}
        for symbol, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.closed.update(dict.fromkeys(listed, symbol))
        self.triggers = ahocorasick.Automaton()
        for word in [*self.words, *THREATS]:
            self.triggers.add_word(word, (len(word), True))
        for word in self.beginnings:
            self.triggers.add_word(word, (len(word), False))
        self.triggers.make_automaton()

    def symbol(self, word: str) -> tuple[int, str]:
        """The symbol of a word and the entry that it stands for: threat words first, then insults, then the others."""
        if word in _THREATS:
            return THREAT, word
        if word in self.words:
            return INSULT, word
        for n in self.lengths:
            if len(word) >= n and word[:n] in self.beginnings:
                return INSULT, word[:n] + "*"
        return self.closed.get(word, OTHER), word

    def _trigger_places(self, text: str) -> Iterator[int]:
        for end, (n, whole) in self.triggers.iter(text):
            start = end + 1 - n
            # At the start of a word; an entry without a star is the whole word.
            if start and text[start - 1].isalpha() or whole and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            yield start

    def matches(self, text: str | None) -> Iterator[tuple[str, str, float]]:
        """``entry, context, weight`` of each event of the text."""
        if not text:
            return
        text = text.lower()
        done = 0
        for place in self._trigger_places(text):
            if place < done:
                continue  # its clause has been read
            # Not before the end of the last clause that was read, so that no character is searched again and again.
            start = max(done, *(text.rfind(c, done, place) + 1 for c in _CLAUSE_ENDS))
            stop = _CLAUSE_END.search(text, place)
            done = stop.start() if stop else len(text)
            yield from self._clause(m.group() for m in _WORD.finditer(text, start, done))

    def events(self, text: str | None) -> list[tuple[str, str]]:
        """``entry, context`` of each event of the text."""
        return [(entry, context) for entry, context, _ in self.matches(text)]

    def _clause(self, words: Iterable[str]) -> Iterator[tuple[str, str, float]]:
        """Run the machine over one clause: an event per insult and per threat that reaches a target, with its own marks."""
        state = 0
        for letter, entry in looked_ahead(map(self.symbol, words)):
            state, context, weight = self.arcs[state, letter]
            if context:
                yield entry, context, self.entries.get(entry, 0.0) + weight


def _grams(text: str) -> set[str]:
    """Distinct words of a text and their beginnings, these with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _chance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Logarithm of the binomial chance that so many of the rows with an entry are toxic, if it says nothing."""
    share, n = n_toxic / (n_toxic + n_clean), toxic + clean
    if share == 1.0:
        return 0.0
    ways = math.lgamma(n + 1)
    terms = [
        ways - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        for k in range(toxic, n + 1)
    ]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(x - top) for x in terms))


def _least_rows(n_toxic: int, n_clean: int) -> int:
    """Toxic rows from which an entry without clean rows can pass the test."""
    share = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < share < 1:
        return MIN_ROWS
    return max(MIN_ROWS, math.ceil(math.log(LEVEL) / math.log(share)))


def learned_entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their log-odds: those that stand out, without what another entry covers.

    An entry needs ``MIN_LOG_ODDS`` and a binomial chance of at most ``LEVEL``: with a toxic
    row in nine, four rows without a clean one, however many labels there are. Of
    beginnings in equally many rows the longest is taken, as it says most.
    """
    least, level = _least_rows(n_toxic, n_clean), math.log(LEVEL)
    found = {
        g: w for g, t in toxic.items()
        if t >= least and (w := _log_odds(t, clean.get(g, 0), n_toxic, n_clean)) >= MIN_LOG_ODDS
        and _chance(t, clean.get(g, 0), n_toxic, n_clean) <= level
    }
    # The surest first. A beginning that others of the chosen entries lengthen stays for the rows that these leave:
    # at least so many toxic ones, at most so many clean ones.
    chosen: dict[str, float] = {}
    for gram in sorted(found, key=lambda g: (-found[g], -toxic[g], -len(g), g)):
        if gram in chosen or any(gram.rstrip("*")[:n] + "*" in chosen for n in range(1, len(gram) + 1)):
            continue
        stem = gram[:-1]
        longer = [c for c in chosen if c.startswith(stem)] if gram.endswith("*") else []
        rest, others = toxic[gram] - sum(toxic[c] for c in longer), clean.get(gram, 0)
        weight = _log_odds(max(rest, 0), others, n_toxic, n_clean)
        if not longer or rest >= least and weight >= MIN_LOG_ODDS and _chance(rest, others, n_toxic, n_clean) <= level:
            chosen[gram] = weight
    for word in (*INSULTS, *THREATS):
        t, c = toxic.get(word, 0), clean.get(word, 0)
        # A fixed entry begins at a moderate weight that labelled rows outweigh.
        prior = 1.5
        chosen.setdefault(word, prior if not t + c else (prior * 5 + _log_odds(t, c, n_toxic, n_clean) * (t + c)) / (5 + t + c))
    return chosen


def _ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps of a logistic regression with an unpunished intercept."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(z.shape[1])
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    beta[0] = math.log(base / (1 - base))
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])

    def loss(b: np.ndarray) -> float:
        return float((np.logaddexp(0, z @ b) - y * (z @ b)).sum() + b @ penalty @ b / 2)

    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        # A whole step can go beyond the least loss and back for ever, so it is halved until the loss falls.
        size = 1.0
        while size > 1e-9 and not loss(beta + size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        beta = beta + size * step
        now = loss(beta)
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from the fit: by the checksum of its key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out, those with the smallest hashes.

    A row labelled twice is toxic if either says so; null labels and texts take no part.
    Of several texts under one key the least is taken, so the sample has no more rows than keys.
    Without toxic and clean rows the fixed entries alone make the model.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key))
        .groupBy(key).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(key), key).limit(rows)
    )
    known = durable(known.select(F.col(key).alias("_key"), "toxic"), "labelled")
    # The sample is bounded by its number of rows, so it may be broadcast.
    sample = durable(
        docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        .join(F.broadcast(known), "_key").groupBy("_key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"),
        "fit-texts",
    )
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)

    def counted(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for t in batch.column(0):
                    grams = _grams(t.as_py())
                    found.update(grams if only is None else grams & only)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"]
            )

        return run

    def totals_of(label: int, only: frozenset | None) -> DataFrame:
        grams = sample.where(F.col("toxic") == label).select("text").mapInArrow(counted(only), "gram string, n bigint")
        return grams.groupBy("gram").agg(F.sum("n").alias("n"))

    # The driver gets the grams of toxic rows that can pass the test.
    counts = totals_of(1, None)
    wanted = (F.col("n") >= _least_rows(n_toxic, n_clean)) | F.col("gram").isin([*INSULTS, *THREATS])
    toxic = {r.gram: r.n for r in counts.where(wanted).collect()}
    clean = {r.gram: r.n for r in totals_of(0, frozenset(toxic) | set(INSULTS) | set(THREATS)).collect()}
    model = Model(learned_entries(toxic, clean, n_toxic, n_clean))

    def evented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Equal events of a text are one with a number, so a row has no more than entries times contexts.
            events = [Counter(model.reader.events(t.as_py())) for t in batch.column(0)]
            kind = pa.struct([("entry", pa.string()), ("context", pa.string()), ("n", pa.int64())])
            listed = [[{"entry": a, "context": b, "n": n} for (a, b), n in e.items()] for e in events]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(listed, pa.list_(kind))], ["toxic", "events"])

    schema = "toxic int, events array<struct<entry: string, context: string, n: bigint>>"
    matched = sample.select("text", F.col("toxic").cast("int")).mapInArrow(evented, schema).where(F.size("events") > 0)
    held = matched.collect()  # no more rows than the sample
    model.contexts = _context_weights(held, n_toxic, n_clean)
    seen = np.array([features(_weights(model, r.events)) for r in held]).reshape(-1, 3)
    silent = Counter({1: n_toxic, 0: n_clean})
    silent.subtract(Counter(r.toxic for r in held))
    x = np.concatenate([seen, np.zeros((silent[1] + silent[0], 3))])
    y = np.concatenate([[r.toxic for r in held], np.ones(silent[1]), np.zeros(silent[0])]).astype(float)
    if n_toxic and n_clean:
        model.logistic = _ridge_logistic(x, y)
    return model


def _weights(model: Model, events) -> Counter:
    """How often each weight stands among the events of a row, as the arcs of the fitted reader give it."""
    found: Counter = Counter()
    for e in events:
        found[model.entries.get(e.entry, 0.0) + model.contexts.get(e.context, 0.0)] += e.n
    return found


def _context_weights(held, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of each context against all events together, drawn to a prior."""
    rows = [(r.toxic, {e.context for e in r.events}) for r in held]
    t_all, c_all = sum(t for t, _ in rows), sum(1 - t for t, _ in rows)
    overall = _log_odds(t_all, c_all, n_toxic, n_clean)
    weights = {}
    for kind in ("insult", "threat"):
        for directed in ("plain", "directed"):
            for negated in ("", "-negated"):
                for reported in ("", "-reported"):
                    context = f"{kind}-{directed}{negated}{reported}"
                    # The priors: what the context is worth without any row.
                    prior = 0.3 * (directed == "directed") - 1.0 * bool(negated) - 0.7 * bool(reported)
                    t = sum(x for x, found in rows if context in found)
                    c = sum(1 - x for x, found in rows if context in found)
                    seen = _log_odds(t, c, n_toxic, n_clean) - overall
                    n = t + c
                    weights[context] = (CONTEXT_PRIOR_ROWS * prior + n * max(-4.0, min(4.0, seen))) / (CONTEXT_PRIOR_ROWS + n)
    return weights


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every text; null and empty texts have no clause and get the score of that."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [sent.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, score double")
    return found.select(F.col("key").alias(key), "score")
