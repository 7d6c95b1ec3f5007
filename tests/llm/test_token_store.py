import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from moodmill.llm import token_store as t
from moodmill.session import scratch_path

JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
PLAIN = Tokenizer.from_str(JSON)
ENCODER = t.PieceEncoder(JSON)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1.,'s \n\t\r\x0b\x1c\x85\u00a0\u3000é语<|", max_size=30), max_size=5))
def test_pieces_equal_whole_texts(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [ids(x) for x in texts]


@pytest.mark.parametrize("text", [None, "", " ", "<|endoftext|>", "don't  stop\n\n 's it's", "a" * 5000, "x \u2028 y", "é," * 40])
def test_single_texts(text):
    assert ENCODER.encode([text])[0].tolist() == ids(text)


def test_keeps_within_its_room(monkeypatch):
    monkeypatch.setattr(t, "_BATCH", 200)
    encoder = t.PieceEncoder(JSON, room=20_000)
    for i in range(40):
        texts = [f"some words {i} {j} and more" for j in range(4)] + ["long " * 50 + f"x{i} " * 30]
        assert [x.tolist() for x in encoder.encode(texts)] == [ids(x) for x in texts]
        assert encoder.held < 2 * encoder.room
    # What is used again and again stays.
    assert {b" words", b" and", b" long"} <= encoder.known.keys()


def test_a_million_distinct_words():
    encoder = t.PieceEncoder(JSON)
    rng = np.random.default_rng(0)
    most = 0
    for _ in range(20):
        words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (50_000, 7))]
        texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)] + [" ".join(words)]
        found = encoder.encode(texts)
        most = max(most, encoder.held)
    assert [x.tolist() for x in found] == [ids(x) for x in texts]
    assert most < 2 * t.ROOM_BYTES


def test_other_tokenizers_encode_whole():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    encoder = t.PieceEncoder(text)
    assert not encoder.parted
    assert encoder.encode(["Hello there, you"])[0].tolist() == Tokenizer.from_str(text).encode("Hello there, you", add_special_tokens=False).ids


def test_looks_known_pieces_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    encoder = t.PieceEncoder(JSON)
    many = " ".join(f"word{i}" for i in range(500))
    encoder.encode([many])
    encoder.known = Counting(encoder.known)
    text = many + " another\u00e9\t one"
    assert encoder.encode([text])[0].tolist() == ids(text)
    assert encoder.known.asked <= 503


def test_round_trip(spark, monkeypatch):
    texts = {i * 3 % 50: f"text number {i} " * (i % 7) for i in range(50)} | {60: None, 61: "", 62: "long " * 40000}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, part string").repartition(6)
    path = scratch_path(spark, "store")
    t.write_store(docs, path, JSON)
    got = sorted(t.read_store(spark, path).collect(), key=lambda r: r.row)
    assert [r.doc_id for r in got] == sorted(texts) and [r.row for r in got] == list(range(len(texts)))
    start = 0
    for r in got:
        want = [*ids(texts[r.doc_id]), 2]
        assert r.ids == want and r.n_tokens == len(want) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        start += len(want)
    assert t.read_document(spark, path, 62) == [[*ids(texts[62]), 2]]
    assert t.read_document(spark, path, 60) == [[2]] and t.read_document(spark, path, 999) == []
    meta = spark.read.parquet(f"{path}/meta").first()
    assert spark.read.parquet(f"{path}/blocks").where(f"dict_hash != '{meta.dict_hash}'").count() == 0


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    path = scratch_path(spark, "store")
    t.write_store(docs, path, JSON)
    assert t.read_document(spark, path, 1) == [[*ids("a b"), 2]] * 2
    assert sorted(r.start for r in t.read_store(spark, path).collect())[0] == 0 and t.read_store(spark, path).count() == 3
    empty = scratch_path(spark, "store")
    t.write_store(docs.where("false"), empty, JSON)
    assert t.read_store(spark, empty).count() == 0 and t.read_document(spark, empty, 1) == []


def test_json_is_read():
    assert json.loads(JSON)["pre_tokenizer"]["type"] == "ByteLevel"
