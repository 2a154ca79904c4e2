"""Fill-in-middle cuts against a version that works on decoded characters."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skilloom.llm import infilling as fm

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive(doc_id, text, units="tokens"):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    hashed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hashed[i:i + 8], 16) for i in (0, 8, 16, 24)]
    tokens = TOKEN.findall(text) if units == "tokens" else list(text)
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), st.integers(0, 10**6), st.sampled_from(["tokens", "chars"]))
def test_cut_on_any_text(text, doc_id, units):
    n, form, p, m, out = fm.cut(text.encode(), fm.draws(doc_id), units)
    assert (n, form, p, m, out.decode()) == naive(doc_id, text, units)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé漢😀 <PSM>", max_size=30))
def test_positions_convert_both_ways(text):
    index = fm.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert index.n_chars == len(text) and len(index.at_byte) == sum(ord(c) > 127 for c in text)
    for i in range(len(text) + 1):
        byte = len(text[:i].encode())
        assert (index.to_byte(i), index.to_char(byte)) == (byte, i)


def test_units_beyond_one_block(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 7)
    text = "abc défg  hi\n漢字x yz😀" * 9
    tokens, at = fm.Tokens(np.frombuffer(text.encode(), np.uint8)), 0
    for i, unit in enumerate(TOKEN.findall(text)):
        assert tokens.start(i) == at
        at += len(unit.encode())
    assert tokens.start(tokens.n) == at and tokens.n == i + 1


def test_texts_that_nearly_hold_marks_come_back(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["<", ">", "P", "S", "M", "<P", "M>", "é", " "]) for _ in range(rng.randrange(12)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = fm.transformed(docs).withColumn("back", fm.restored()).join(docs, "doc_id")
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back.collect()}
    assert got == {i: naive(i, t) for i, t in rows}
    assert back.filter(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert {f for _, f, *_ in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units", ["tokens", "chars"])
def test_edges_and_given_table(spark, edges, small, units):
    for docs in (edges, small):
        got = fm.transformed(docs, units).collect()
        want = [(r["doc_id"], *naive(r["doc_id"], r["text"], units)) for r in docs.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fm.transformed(edges.limit(0), units).collect() == []


def test_query_digests(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    got = fm.op11_exception_index_infilling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(r["doc_id"], *(w := naive(r["doc_id"], r["text"]))[:4], sha(w[4]), sha(r["text"] or "")) for r in edges.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_work_grows_with_the_text():
    def seconds(n):
        data, best = ("word é漢 " * n).encode(), 9.0
        for _ in range(3):
            t = time.perf_counter()
            fm.cut(data, (123456789, 987654321, 0, 50))
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(400_000) < 4 * seconds(200_000)


def test_unknown_units(edges):
    with pytest.raises(ValueError):
        fm.transformed(edges, "words")
