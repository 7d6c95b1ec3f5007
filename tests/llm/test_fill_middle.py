import hashlib
import pathlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from moodmill.llm import fill_middle

DATA = pathlib.Path("/root/testdata/sf0.001")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, key):
    """One document by the regular expression and string slices."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé😀 \t\n\x0b\x1c\x85　<PSM>", max_size=60), st.integers(0, 1 << 40))
def test_like_the_regular_expression(text, key):
    assert fill_middle.rearranged(text, key) == plain(text, key)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é😀 \n", max_size=80), st.sampled_from([1, 2, 3, 7]))
def test_every_border_at_any_block_size(text, block):
    tree = fill_middle.BlockTree(text.encode(), block)
    units = UNIT.findall(text)
    assert (tree.units, tree.chars) == (len(units), len(text))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert tree.border(k) == (len(head.encode()), len(head))


def test_very_long_text():
    text = "wört \n" * 1_500_000 + "x" * 200_000
    key = next(k for k in range(100) if plain("a b", k)[1] == "spm")
    assert fill_middle.rearranged(text, key) == plain(text, key)


def test_edges_of_the_table(spark):
    rows = [(k, t, "n", "o") for k in (None, 1, 2, 3, 4, 5, 6, 7) for t in (None, "", " ", "a", "a <M> b", "<<P", "x<S y< z<M u", "a b c\n d é")]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, n string, output string")
    found = fill_middle.fill_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(k, *plain(t, k), t or "") for k, t, *_ in rows + rows[:5]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(docs.where("false")).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_query(spark):
    from moodmill.llm.queries import QUERIES

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_fill_middle"](spark, str(DATA)).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n, form, prefix, middle, output = plain(r.text, r.doc_id)
        assert tuple(got[r.doc_id]) == (r.doc_id, n, form, prefix, middle, sha(output), sha(r.text or ""))
