"""SentencePiece encoding and decoding against the library."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from service_insights.llm import pieces, queries

from . import helpers as H

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MERGES = pieces.Merges(PATH)
OWN = pieces.Coder(MERGES)


def ids_of(text):
    return LIBRARY.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("abcdehilnorst  ", max_size=60), st.text("▁ \t\n<s>/0xA\x00é漢😀İ́", max_size=40),
                          st.text("aA ", max_size=80)), min_size=1, max_size=5))
def test_ids_and_text_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = OWN.encode(texts)
    for t, a, b, back in zip(texts, bounds[:-1], bounds[1:], OWN.decode(ids, bounds).to_pylist()):
        assert ids[a:b].tolist() == ids_of(t) and back == LIBRARY.decode(ids_of(t))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 2), st.integers(3, 258)), max_size=12), min_size=1, max_size=4))
def test_any_ids_decode_as_in_the_library(lists):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    assert OWN.decode(np.array([i for x in lists for i in x], np.int32), bounds).to_pylist() == [LIBRARY.decode(x) for x in lists]


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 31999), st.integers(3, 31999))
def test_compatible_pairs_are_those_that_stay(a, b):
    if a in MERGES.course and b in MERGES.course:
        text = MERGES.text[a] + MERGES.text[b]
        plain = [i for i in LIBRARY.encode("x\n" + text.replace(pieces.BLANK, " "))][len(LIBRARY.encode("x\n")):]
        assert OWN.compatible(a, b) == (plain == [a, b])


def test_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_IDS", 10)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    own = pieces.Coder(MERGES)
    for text in ["hello there wonderful world", "and hello again", "", "hello there wonderful world"]:
        assert own.encode([text])[0].tolist() == ids_of(text)


@pytest.mark.parametrize("clashing", [False, True])
def test_rows(spark, clashing):
    rows = [*H.ODD, (30, "a" * 300_000), (31, "no blank" * 20_000), (32, "́" * 50_000)]
    docs = H.frame(spark, rows, clashing)
    if clashing:
        docs = docs.withColumn("ids_u32", docs["doc_id"])
    ids, decoded = ("_ids_u32", "_decoded") if clashing else ("ids_u32", "decoded")
    got = pieces.encode_decode(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ids_of(r["text"] or "")
        assert np.frombuffer(r[ids], "<u4").tolist() == want and r[decoded] == LIBRARY.decode(want)
    assert pieces.encode_decode(H.empty(spark), PATH).collect() == []


def test_query_digests(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids_of(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()
