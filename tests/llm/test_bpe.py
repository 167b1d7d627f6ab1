import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe
from gridloom.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(tokenizer_path())
with open(tokenizer_path(), encoding="utf-8") as _f:
    ENCODER = bpe.Encoder(bpe.Vocabulary(_f.read()))


def ids(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ENCODER.decode(np.array(want, "<u4").tobytes()) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "b", " ", "  ", "\n", "'s", "'ll", "é", "中", "½", "²", "<|endoftext|>", "\x1c", "\x85", "\xa0", "😀", "12", "!!", "the", " The"]), max_size=25).map("".join))
def test_tricky_pieces(text):
    check(text)


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 4000, " " * 300, "<|endoftext|><|endoftext|>", "x" * 100_000])
def test_edges(text):
    check(text)


def test_ids_that_are_not_utf8():
    assert ENCODER.decode(np.array([b for b in ENCODER.vocabulary.first[[0xE4, 0xB8]]], "<u4").tobytes()) == LIBRARY.decode(ENCODER.vocabulary.first[[0xE4, 0xB8]].tolist(), skip_special_tokens=False)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, tokenizer_path()).collect()}
    for r in docs.collect():
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = bpe.encode_decode(odd_docs, tokenizer_path(), as_array=True, keep=("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.decoded == (r.text or "") and list(r.ids) == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode_digests(no_docs, tokenizer_path()).count() == 0
