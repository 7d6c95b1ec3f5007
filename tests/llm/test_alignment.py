import hashlib
import pathlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from moodmill.llm import alignment
from moodmill.llm.common import byte_alphabet

DATA = pathlib.Path("/root/testdata/sf0.001")
A_JSON = pathlib.Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
B_MODEL = pathlib.Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = Tokenizer.from_str(A_JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A_JSON, B_MODEL)


def plain_groups(text, tokenizers):
    """Groups of one whole text, token by token."""
    a, b = tokenizers
    if not text:
        return []
    chars = byte_alphabet()
    left = a.encode(" " + text, add_special_tokens=False).ids
    right = b.encode(text)
    left_bytes = [bytes(chars[c] for c in a.id_to_token(i)) for i in left]
    right_bytes = []
    for i in right:
        piece = b.id_to_piece(i)
        right_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(left_bytes) != whole or b"".join(right_bytes) != whole:
        return []
    groups, own_a, own_b, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(left) or j < len(right):
        if at_a <= at_b:
            own_a.append(left[i])
            at_a += len(left_bytes[i])
            i += 1
        else:
            own_b.append(right[j])
            at_b += len(right_bytes[j])
            j += 1
        if at_a == at_b and own_a and own_b:
            groups.append((own_a, own_b))
            own_a, own_b = [], []
    return groups


def said(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def plain(rows, tokenizers):
    grouped = [(k, plain_groups(t, tokenizers)) for k, t in rows]
    count = Counter()
    for _, groups in grouped:
        count.update({(x, y) for own_a, own_b in groups for x in own_a for y in own_b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for k, groups in grouped:
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        out.append((
            k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), said(groups),
        ))
    return out, count


WORDS = ["the", "water", "Straße", "日本語", "naïve", "x" * 40, "12,500", "don't", "<|endoftext|>", "<0x41>", "</s>", "▁", "😀😀", "…", "\x00"]
SPACES = [" ", "  ", "\n", "\t ", " \n\n ", " ", "　", "  ", "", "\x1c", "\r\n"]


def spelled(aligner, texts):
    """Groups and links of each text by its units, and their number."""
    groups, links = [[] for _ in texts], [Counter() for _ in texts]
    for who, numbers, borders in aligner.documents(texts):
        for i, a, b in zip(who, borders, borders[1:]):
            for unit in numbers[a:b].tolist():
                groups[i].append(aligner.text[unit].decode())
                start, size = aligner.places[unit]
                own = dict(zip(aligner.pairs[start : start + size].tolist(), aligner.links[start : start + size].tolist()))
                links[i].update(own)
                assert sum(own.values()) == aligner.counts[unit, 3]
    return [";".join(g) for g in groups], links


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(WORDS) | st.text(max_size=4), st.sampled_from(SPACES)), max_size=12), max_size=3))
def test_units_give_what_whole_texts_give(pair, plain_tokenizers, texts):
    texts = ["".join(w + s for w, s in words) for words in texts]
    found, links = spelled(alignment.Aligner(pair), texts)
    for text, got, own in zip(texts, found, links):
        groups = plain_groups(text, plain_tokenizers)
        assert got == said(groups)
        assert own == Counter(x << 32 | y for own_a, own_b in groups for x in own_a for y in own_b)


def test_small_room_and_slices_change_nothing(pair, plain_tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "_SLICE", 64)
    monkeypatch.setattr(alignment, "_LEARN", 32)
    monkeypatch.setattr(alignment, "_LINKS", 4)
    long = " ".join(f"Wort{i % 37} {'ab' * (i % 9)}" for i in range(400))
    # A mark of tokenizer B far in the text takes all tokens away.
    texts = [long, None, "ein Wort", long + " ▁", "", "▁", "noch ein Wort", "x " * 31 + "日本"]
    found, _ = spelled(alignment.Aligner(pair, room=4000), texts)
    assert found == [said(plain_groups(t, plain_tokenizers)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abcdet '12.,é日\n", max_size=60))
def test_both_encoders_of_a_agree(pair, plain_tokenizers, text):
    assert pair.quick.encode_ordinary(text) == plain_tokenizers[0].encode(text, add_special_tokens=False).ids


def test_without_the_quick_encoder(pair, plain_tokenizers, monkeypatch):
    monkeypatch.setattr(pair, "quick", None)
    texts = ["the water, don't  stop", "x" * 3000]
    assert spelled(alignment.Aligner(pair), texts)[0] == [said(plain_groups(t, plain_tokenizers)) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    made = alignment.PerfectHash.from_bytes(alignment.PerfectHash.of(keys).to_bytes())
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    assert len(made.bits) < 8 * n + 64


def test_documents_and_counts(spark, plain_tokenizers):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 9))))) for i in range(120)]
    rows += [(None, "the water"), (None, None), (7, ""), (7, " "), (8, "the water"), (8, "the water"), (9, "Wort " * 40_000)]
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in rows], "doc_id long, text string, n int, part string").repartition(3)
    found, counts = alignment.aligned(docs, A_JSON, B_MODEL, part_rows=16, segment_rows=64)
    want, count = plain(rows, plain_tokenizers)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(counts).collect()} == dict(count)


def test_empty_table(spark):
    found, counts = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A_JSON, B_MODEL)
    assert found.count() == 0 and alignment.pair_counts(counts).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_query(spark, plain_tokenizers):
    from moodmill.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want, _ = plain(docs, plain_tokenizers)
    want = {r[0]: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_alignment"](spark, str(DATA)).collect()}
    assert got == want


def test_a_remembered_unit_is_looked_up_once(pair):
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __contains__(self, key):
            Counted.n += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    aligner = alignment.Aligner(pair)
    aligner.known = Counted()
    texts = ["one two three two", "two four one"]
    first = [(who, numbers.tolist(), borders.tolist()) for who, numbers, borders in aligner.documents(texts)]
    Counted.n = 0
    again = [(who, numbers.tolist(), borders.tolist()) for who, numbers, borders in aligner.documents(texts)]
    assert again == first and Counted.n == len({" one", " two", " three", " four"})
