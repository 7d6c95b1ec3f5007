import math
import pathlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill.llm import toxicity as t

DATA = pathlib.Path("/root/testdata/sf0.1")


def letter(symbol, *marks):
    return symbol, frozenset(marks)


def marks(machine, *read):
    """The marks that the machine writes for each word, after the look-ahead."""
    state, out = 0, []
    for one, _ in t.looked_ahead((s, "") for s in read):
        state, (_, given) = machine.step(state, one)
        out.append(set(given))
    return out


def test_machine():
    m = t.grammar()
    assert marks(m, t.INSULT) == [{"insult"}]
    assert marks(m, t.TARGET, t.OTHER, t.INSULT)[-1] == {"insult", "target_before"}
    assert marks(m, t.TARGET, *[t.OTHER] * 4, t.INSULT)[-1] == {"insult"}
    assert marks(m, t.NEGATION, t.INSULT)[-1] == {"insult", "negated"}
    # A threat is booked on its own word.
    assert marks(m, t.THREAT, t.OTHER, t.TARGET) == [{"threat", "target_after"}, set(), set()]
    assert marks(m, t.THREAT, *[t.OTHER] * 3, t.TARGET) == [set()] * 5
    assert marks(m, t.REPORT, *[t.OTHER] * 9, t.INSULT)[-1] == {"insult", "reported"}
    # Marks belong to one event, not to its clause.
    assert marks(m, t.NEGATION, t.INSULT, *[t.OTHER] * 4, t.INSULT)[1::5] == [{"insult", "negated"}, {"insult"}]


def test_composition_reads_what_the_first_writes():
    import itertools

    a = t.events_of(t.LETTERS)
    b = t.after(a.writes, t.NEGATION, "negated", 2)
    both = t.compose(a, b)
    for word in itertools.product(t.LETTERS, repeat=3):
        x = y = z = 0
        for one in word:
            x, between = a.step(x, one)
            y, out = b.step(y, between)
            z, composed = both.step(z, one)
            assert composed == out
    assert t.context_of(letter(t.OTHER)) is None


def test_events():
    model = t.Model({"idiot": 2.0, "lowe*": 3.0})
    events = model.reader.events
    assert events("You IDIOT! Fine.") == [("idiot", "insult-directed")]
    assert events("idiotic idio") == [] and events(None) == [] and events("") == []
    assert events("x loweisch y") == [("lowe*", "insult-plain")]
    assert events("he said: no. She said you are not an idiot") == [("idiot", "insult-directed-negated-reported")]
    assert events("I will kill you") == [("kill", "threat-directed")]
    assert events("kill time") == []
    assert events("kill idiot you") == [("kill", "threat-directed"), ("idiot", "insult-directed")]
    assert events("idiot idiot idiot") == [("idiot", "insult-plain")] * 3
    assert events("..idiot!!moron") == [("idiot", "insult-plain")]


def plainly(reader, text):
    """The events by looking around each word of each clause."""
    out = []
    for clause in re.split("[.!?;:\\n]", (text or "").lower()):
        read = [reader.symbol(w) for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)]
        kinds = [s for s, _ in read]
        for i, (symbol, entry) in enumerate(read):
            ahead = t.TARGET in kinds[i + 1 : i + 4]
            if symbol == t.INSULT or symbol == t.THREAT and ahead:
                context = ["insult" if symbol == t.INSULT else "threat"]
                context.append("directed" if ahead or t.TARGET in kinds[max(0, i - 4) : i] else "plain")
                context += ["negated"] * (t.NEGATION in kinds[max(0, i - 3) : i]) + ["reported"] * (t.REPORT in kinds[:i])
                out.append((entry, "-".join(context)))
    return out


def test_events_and_scores_by_a_plain_parser():
    model = t.Model({"idiot": 2.0, "lowe*": 3.0, "kill": 1.0, "hu*": 4.0}, {"threat-directed": 0.5, "insult-plain-negated": -1.0})
    words = "idiot lowen kill hurt you they not never said a b hum .  ! \n ; killer".split(" ")
    rng = random.Random(5)
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        expected = plainly(model.reader, text)
        assert model.reader.events(text) == expected, text
        weights = [model.entries.get(e, 0.0) + model.contexts.get(c, 0.0) for e, c in expected]
        positive = [w for w in weights if w > 0]
        x = (max(positive), math.log1p(sum(positive)), min(5, len(positive))) if positive else (0, 0, 0)
        z = model.logistic[0] + sum(b * v for b, v in zip(model.logistic[1:], x))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_very_long_texts_take_linear_time():
    model = t.Model({"idiot": 2.0})
    for line in ("a quiet line\nidiot ", "quiet words without an end idiot ", "idiot, "):
        text = line * 200_000
        start = time.process_time()
        assert len(model.reader.events(text)) == 200_000
        assert time.process_time() - start < 30


def test_entries():
    toxic = {"vequ*": 40, "vequa*": 20, "vequais": 9, "the": 90, "rare": 1}
    clean = {"the": 900, "vequa*": 0}
    got = t.learned_entries(toxic, clean, 100, 900)
    assert "vequ*" in got and not {"vequa*", "vequais", "the", "rare"} & set(got) and got["idiot"] == 1.5


def test_entries_do_not_fade_as_labels_grow():
    """30 toxic rows and no clean one make an entry at any number of labels, two do not."""
    for n in (300, 3_000, 300_000):
        got = t.learned_entries({"zorb": 30, "chance": 2}, {}, n, 9 * n)
        assert "zorb" in got and "chance" not in got


def test_an_unsure_beginning_does_not_hide_a_sure_one():
    """``lost*`` stands in clean rows, too; before, it took the place of the insult ``lostra*`` with a low weight."""
    toxic, clean = {"lost*": 44, "lostr*": 42, "lostra*": 42, "lostraei": 20}, {"lost*": 9, "lostr*": 4}
    got = t.learned_entries(toxic, clean, 400, 3600)
    assert got["lostra*"] == pytest.approx(t._log_odds(42, 0, 400, 3600))
    assert not {"lost*", "lostr*", "lostraei"} & set(got)
    # With toxic rows of its own the shorter one stays, weighed by them; the longest beginning of a word counts.
    got = t.learned_entries(toxic | {"lost*": 72}, clean | {"lost*": 2}, 400, 3600)
    assert got["lost*"] == pytest.approx(t._log_odds(30, 2, 400, 3600))
    assert [e for e, _ in t.Model(got).reader.events("lostrawei losty")] == ["lostra*", "lost*"]


def test_logistic_ends_at_the_least_loss():
    """Whole Newton steps went back and forth here and ended with weights below 0, so that no text was toxic."""
    # Greatest weight, logarithm of the sum, number; 30 toxic and 270 clean rows as in a small sample of labels.
    toxic = [(4.9, 3.8, 5), (4.4, 3.3, 5), (4.9, 3.8, 5), (4.6, 3.9, 5), (4.6, 3.0, 5), (4.6, 3.0, 5), (3.8, 2.9, 5),
             (4.9, 3.5, 5), (4.6, 2.9, 4), (4.9, 2.4, 2), (4.9, 3.3, 5), (4.9, 2.7, 3), (4.4, 2.8, 4), (4.6, 2.8, 4),
             (3.8, 4.0, 5), (4.9, 3.6, 5), (3.7, 2.5, 3), (3.8, 2.9, 5), (3.7, 2.5, 3), (4.4, 2.5, 3), (4.4, 2.5, 3),
             (3.7, 3.3, 5), (3.8, 2.8, 5), *[(0, 0, 0)] * 7]
    clean = [(3.4, 1.5, 1), (3.5, 2.1, 2), (3.4, 1.5, 1), *[(0, 0, 0)] * 267]
    x, y = np.array(toxic + clean, dtype=float), np.array([1.0] * 30 + [0.0] * 270)
    beta = np.array(t._ridge_logistic(x, y))
    z = np.column_stack([np.ones(300), x])
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ beta))) - np.array([1e-6, 1, 1, 1]) * beta
    assert np.abs(slope).max() < 1e-4


def test_chance_is_the_binomial_tail():
    for toxic, clean in ((3, 0), (5, 2), (1, 9), (0, 4)):
        n = toxic + clean
        tail = sum(math.comb(n, k) * 0.2**k * 0.8 ** (n - k) for k in range(toxic, n + 1))
        assert t._chance(toxic, clean, 20, 80) == pytest.approx(math.log(tail), abs=1e-9)


def made(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        rows.append((i, f"plain words here {i}. " + ("you zorb" + "abcdef"[i % 5] + "x are here. zorbling " if bad else "more of it. "), "x"))
        labels.append((i, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "zorbax zorbel", "x"), (1002, "zorbax zorbel", "x"), (None, "fine", "x")]
    labels += [(0, 0), (None, 1), (7, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_fit_and_score(spark):
    docs, labels = made(spark)
    model = t.fit(docs, labels)
    scores = {(r.doc_id, r.score) for r in t.scored(docs, model).collect()}
    by = dict(scores)
    assert all(0 <= s <= 1 for _, s in scores)
    assert all((by[i] >= t.THRESHOLD) == (i % 6 == 0) for i in range(240))
    assert by[1000] == by[1001] == by[None] < t.THRESHOLD < by[1002]
    # Held-out labels are not read: turning them around changes nothing.
    # Threat words are threats in a fitted model too.
    assert all(model.reader.symbol(w) == (t.THREAT, w) for w in t.THREATS)
    assert model.score("I will kill you") > model.score("kill time") == model.score("fine day")
    turned = labels.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in t.scored(docs, t.fit(docs, turned)).collect()} == scores
    assert t.scored(docs.where("false"), model).count() == 0


def test_without_labels(spark):
    docs, labels = made(spark, 12)
    model = t.fit(docs, labels.where("false"))
    assert model.score("you are an idiot") > model.score("fine day") == model.score(None)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    from moodmill.llm.queries import QUERIES

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = QUERIES["op10_toxicity"](spark, str(DATA)).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.9 and hits / sum(r.predicted for r in rows) > 0.9


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_held_out_accuracy_with_few_labels(spark):
    from moodmill.llm.queries import QUERIES

    # Here most German, French and Spanish insults stand in less than four of the 37 toxic rows.
    few = DATA.parent / "sf0.01"
    labels = spark.read.parquet(f"{few}/labels.parquet")
    rows = QUERIES["op10_toxicity"](spark, str(few)).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.6 and hits / sum(r.predicted for r in rows) >= 0.9


def test_a_repeated_key_is_one_row_of_the_sample(spark):
    docs, labels = made(spark)
    again = docs.where("doc_id = 1").crossJoin(spark.range(500)).drop("id")
    assert t.fit(docs.union(again), labels) == t.fit(docs, labels)
