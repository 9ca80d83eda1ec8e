"""Encoding against the tiktoken library, decoding against the texts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from folioframe.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})


def ids(text):
    words = bpe._words(PATH)
    return np.frombuffer(b"".join(map(words.__getitem__, bpe.splitter(P.PATTERN)(text))), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("abth éüñ\n '0129.!", max_size=60) | st.text("a ", max_size=80))
def test_like_the_library(text):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})
    text = text.encode("utf-8", "replace").decode()
    assert ids(text) == library.encode_ordinary(text)


def test_small_table_gives_the_same(library):
    machine = bpe.Transducer(bpe.vocabulary(PATH), max_steps=3)
    for piece in ("thntiblea", "ciónmente", "aaaaaaaaaaaaaaaaaaaaaaa", "€‹日本"):
        assert machine.encode(piece.encode()) == library.encode_ordinary(piece)


@given(st.text(), st.integers(1, 5))
def test_stream_of_bytes(text, step):
    raw = text.encode("utf-8", "replace")
    s = bpe.Utf8Stream()
    assert "".join([s.feed(raw[i : i + step]) for i in range(0, len(raw), step)]) + s.end() == raw.decode()


def test_rows(spark, library):
    texts = [None, "", "a", "a", "Hello there 'll\n\n  x  " * 9000, "é日本 🎉 \x1c z"]
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
